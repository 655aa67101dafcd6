"""Text values cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.comun import fijar

CAMPOS = ("contenido_original", "contenido_final", "comentarios")
BITS = 1 << 26  # of the filter of decided blocks: 8 MB, whatever the number of blocks
MARCA = r"(?:…|\.\.\.|\[…\]|\[\.\.\.\]|�)+[\s]*$"
_MARCA = re.compile(MARCA)
_TERMINAL = re.compile(r"[.!?∎][»”\"')\]$*_ ]*$|[.!?]\s*(?:\\end\{\w+\*?\}|\\\])\s*$")
_ADORNO = re.compile(r"^(?:[-—·\[(| ]*\d{1,4}(?:\s*(?:/|de|of)\s*\d{1,4})?[-—·\])| ]*|(?:p|pp|pág|pag|page|seite|s)\.?\s*\d{1,4}|[ivxlc]{1,7})$", re.I)
_PALABRA = re.compile(r"[^\W\d_]{2,}")
_FILA = re.compile(r"\||&|\t|;.*;|\S {2,}\S")
_ENTRADA = re.compile(r"^\s*(?:[-•*▪‣–]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)])\s|(?:\. ?){4,}\s*\d*\s*$|(?:,\s*\d{1,4})+\s*$")
_CODIGO = re.compile(r"^\s*(?:def |for |while |if |return |import |print\(|#|\w+\s*[+*-]?=[^=])", re.M)


def _plano(s: str) -> str:
    return " ".join(s.split())


def fin_de(valor: str, completo: list[str], nota: bool = False) -> str:
    """How a value ends: ``entero``, ``cortado``, ``corto`` (ends like running text that goes on) or ``libre`` (cannot be told from its end).

    ``completo`` holds longer versions of the same text, if any are stored: a value that is
    the beginning of one and stops within its sentence, formula, entry or row is cut.
    ``nota``: a reviewer's remark, which has no whole text, lists or page numbers.
    """
    sin = _MARCA.sub("", valor)
    marcado = sin != valor
    v = _plano(sin)
    if not v:
        return "libre"
    for c in completo:
        p = _plano(c)
        if v == p or _plano(valor) == p:
            return "entero"
        if not p.startswith(v):
            continue
        if _TERMINAL.search(v):
            return "entero"
        # whole lines of a list, a table or code may be left out on purpose
        resto = c.strip()[_hasta(c.strip(), len(v.replace(" ", ""))) :]
        if not marcado and "\n" in valor.strip() and resto[:1] in ("\n", "") and (_ENTRADA.search(valor.strip().split("\n")[-1]) or _FILA.search(valor.strip().split("\n")[-1])):
            return "entero"
        return "cortado"
    if nota:  # a remark of a reader: sentences, or a few words without a full stop
        return "entero" if _TERMINAL.search(v) else "cortado" if marcado or len(_PALABRA.findall(v)) >= 5 else "libre"
    lineas = [x.strip() for x in sin.strip().split("\n") if x.strip()]
    # page numbers and headers of the scan stand after the end of the text
    while len(lineas) > 1 and (_ADORNO.match(lineas[-1]) or (len(lineas[-1]) <= 45 and _TERMINAL.search(lineas[-2]) and not _TERMINAL.search(lineas[-1]) and (lineas[-1].isupper() or len(lineas[-1].split()) <= 5))):
        lineas.pop()
    t = " ".join(lineas)
    if _TERMINAL.search(t) or re.search(r"[.!?∎] +(?:[-—·\[(|]+ ?)?(?:(?:[pP]|[pP]ág|[pP]age|[sS]eite|[sS])\.? ?)?(?:\d{1,4}(?: ?/ ?\d{1,4})?|[ivxlc]{1,7})(?: ?[-—·\])|]+)?$", t):
        return "corto" if marcado and not _TERMINAL.search(v) else "entero"
    if t.count("{") > t.count("}") or t.count("\\begin") > t.count("\\end") or t.endswith("\\"):
        return "cortado" if not t.endswith("\\\\") else "libre"
    if _CODIGO.search(sin) or sum(bool(_ENTRADA.search(x) or _FILA.search(x)) for x in lineas) * 2 > len(lineas):
        return "corto" if marcado else "libre"
    palabras = _PALABRA.findall(t)
    if len(palabras) < 6 or "\\" in t and len(_PALABRA.findall(re.sub(r"\\[A-Za-z]+", "", t))) < 6:
        return "corto" if marcado and len(palabras) > 3 else "libre"
    if not re.search(r"[.!?:,;»] ", t) and len(palabras) < 10 and not marcado:
        return "libre"
    return "cortado"


def _hasta(c: str, letras: int) -> int:
    """Position in c after ``letras`` characters that are no white space."""
    n = 0
    for i, x in enumerate(c):
        if n == letras:
            return i
        n += not x.isspace()
    return len(c)


@F.pandas_udf(T.StringType())
def _fin(lotes: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for valor, completo, campo in lotes:
        yield pd.Series([None if v is None else fin_de(v, [x for x in (c if c is not None else []) if x], k == "comentarios") for v, c, k in zip(valor, completo, campo)], dtype=object)


def _decididos(bloques: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``bloques`` whose ``bloque_id`` may be in ``ids``: a bitmap of fixed size over hashed ids.

    The bitmap has at most ``BITS`` bits, so it may be broadcast; a block that is let through
    by a clash of hashes drops out in the join that follows.
    """
    h = F.pmod(F.xxhash64("bloque_id"), F.lit(BITS)) + 1
    mapa = ids.select(F.bitmap_bucket_number(h).alias("cubo"), F.bitmap_bit_position(h).alias("bit")).groupBy("cubo").agg(F.bitmap_construct_agg("bit").alias("mapa"))
    b = bloques.withColumn("cubo", F.bitmap_bucket_number(h)).withColumn("bit", F.bitmap_bit_position(h)).join(F.broadcast(mapa), "cubo")
    octeto = F.expr("cast(conv(hex(substring(mapa, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
    return b.where(F.shiftrightunsigned(octeto, 0).bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0).select(*bloques.columns)


def valores(decisiones: DataFrame, bloques: DataFrame | None = None) -> DataFrame:
    """``(decision_id, fuente, campo, valor, fin)`` of the non-empty values of distinct decisions; null is a source.

    ``bloques`` gives the stored whole texts of the decided blocks, which show what a cut
    value went on with.  It is reduced to the decided blocks, by a filter of fixed size,
    before its texts are shuffled.
    """
    d = decisiones.where("id is not null").select(F.col("id").alias("decision_id"), F.col("revisor").alias("fuente"), "bloque_id", *CAMPOS).dropDuplicates(["decision_id"])
    pares = ", ".join(f"'{c}', {c}" for c in CAMPOS)
    v = d.select("decision_id", "fuente", "bloque_id", F.expr(f"stack({len(CAMPOS)}, {pares}) as (campo, valor)")).where("trim(valor) <> ''")
    if bloques is None:
        v = v.withColumn("completo", F.array().cast("array<string>"))
    else:
        b = bloques.select(F.col("id").alias("bloque_id"), F.array_compact(F.array("texto_plano", "latex", "contenido_final")).alias("completo"))
        b = _decididos(b, decisiones.select("bloque_id").where("bloque_id is not null")).dropDuplicates(["bloque_id"])
        v = v.join(b, "bloque_id", "left").withColumn("completo", F.when(F.col("campo") != "comentarios", F.col("completo")))
    return v.select("decision_id", "fuente", "campo", "valor", _fin("valor", "completo", "campo").alias("fin"))


UNIDADES = {"caracteres": "char_length(valor)", "bytes": "octet_length(valor)", "sin_marca": f"char_length(regexp_replace(valor, '{MARCA.replace(chr(92), chr(92) * 2)}', ''))"}


def picos(v: DataFrame, minimo: int = 3, factor: float = 4.0, ancho: int = 12) -> DataFrame:
    """``(fuente, campo, unidad, largo, n, maximo)``: lengths at which a source's values pile up, in characters, in bytes, and in characters before a cut mark.

    Histograms of the lengths of values without terminal punctuation; a length is a spike
    if it holds at least ``minimo`` values, ``factor`` times what its neighbours within
    ``ancho`` hold on average, and half of its values, at least ``minimo``, are different
    ones (a remark that is given again and again makes no spike).  It is at the ``maximo`` if
    it holds as many different values as all greater lengths together.  Aggregated by length before any window, so a
    source with a third of all rows is a histogram like any other.
    """
    pares = ", ".join(f"'{k}', {x}" for k, x in UNIDADES.items())
    h = (
        v.where(F.col("fin") != "entero").select("fuente", "campo", F.xxhash64("valor").alias("h"), F.expr(f"stack({len(UNIDADES)}, {pares}) as (unidad, largo)"))
        .groupBy("fuente", "campo", "unidad", "largo").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("d"))
    )
    w = Window.partitionBy("fuente", "campo", "unidad").orderBy("largo").rangeBetween(-ancho, ancho)
    vecinos = (F.sum("n").over(w) - F.col("n")) / (2 * ancho)
    encima = F.sum("d").over(Window.partitionBy("fuente", "campo", "unidad").orderBy(F.desc("largo")).rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("vecinos", vecinos).withColumn("maximo", F.col("d") >= F.coalesce(encima, F.lit(0)))
    return h.where((F.col("n") >= factor * F.col("vecinos")) & (F.col("d") >= minimo) & (2 * F.col("d") >= F.col("n"))).drop("vecinos", "d")


def analizados(decisiones: DataFrame, bloques: DataFrame | None = None) -> DataFrame:
    """``(decision_id, fuente, campo, fin, en_pico, regla, cortado)`` of every non-empty value.

    First rule, ``pico``: a value at a spike length of its source and field without terminal
    punctuation is cut, one whose end tells nothing (a list, a table, code, a few words) if
    the spike is at the maximum; an exact check follows, a stored whole text that equals the
    value shows it complete.  Second rule, ``transferencia``: a value cut in transfer has no common
    length; it stops in the middle of running text, of a formula or of the stored whole
    text.  ``regla`` names the rule that holds first.  Null and empty values give no row.
    """
    v = fijar(valores(decisiones, bloques))
    # lengths at which some source spikes; one row per source, field and spike
    p = picos(v)
    nulo = F.lit("\u0000")
    m = v.withColumn("f", F.coalesce("fuente", nulo))
    for k, x in UNIDADES.items():
        pk = p.where(F.col("unidad") == k).select(F.coalesce("fuente", nulo).alias("f"), "campo", F.col("largo").alias(f"l_{k}"), F.col("maximo").alias(f"p_{k}"))
        m = m.withColumn(f"l_{k}", F.expr(x)).join(pk, ["f", "campo", f"l_{k}"], "left")
    alguno = F.greatest(*[F.col(f"p_{k}") for k in UNIDADES])  # null: at no spike
    en_pico = alguno.isNotNull()
    regla = F.when(F.col("fin") == "entero", None).when(F.when(F.col("fin") == "libre", F.coalesce(alguno, F.lit(False))).otherwise(en_pico), "pico").when(F.col("fin").isin("cortado", "corto"), "transferencia")
    return m.select("decision_id", "fuente", "campo", "fin", en_pico.alias("en_pico"), regla.alias("regla"), regla.isNotNull().alias("cortado"))


def cortados(decisiones: DataFrame, bloques: DataFrame | None = None) -> DataFrame:
    """``(decision_id, campo)`` of the cut values."""
    return analizados(decisiones, bloques).where("cortado").select("decision_id", "campo")


def tasas(decisiones: DataFrame, bloques: DataFrame | None = None) -> DataFrame:
    """``(revisor, campo, n_valores, n_cortados, n_por_pico, n_por_transferencia, tasa)`` per source and field; null is a source."""
    return (
        analizados(decisiones, bloques).groupBy(F.col("fuente").alias("revisor"), "campo")
        .agg(F.count("*").alias("n_valores"), F.count_if("cortado").alias("n_cortados"), F.count_if(F.col("regla") == "pico").alias("n_por_pico"), F.count_if(F.col("regla") == "transferencia").alias("n_por_transferencia"))
        .withColumn("tasa", F.col("n_cortados") / F.col("n_valores"))
    )
