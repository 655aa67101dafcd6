"""Document-level consistency: numbering, cross references, structural index, spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.texto import estructura_valida, numero, numero_corto, reparacion_ambigua, tipo_normal
from legajo.sources.tablas import unicos

NUMERADOS = ("teorema", "lema", "proposicion", "definicion", "corolario")
# --- fixed values: names of referenced statements ----------------------------------------------
REFERENCIA = r"(?iU)\b(Teorema|Lema|Proposición|Definición|Corolario)\s+(\d+(?:\.\d+)*)"
# --- end of fixed values -----------------------------------------------------------------------


def numerados(bloques: DataFrame) -> DataFrame:
    """``(documento_id, bloque_id, tipo, pagina, num array<bigint>)`` of statements that carry a number."""
    b = bloques.select("documento_id", F.col("id").alias("bloque_id"), tipo_normal(F.col("tipo")).alias("tipo"), "pagina", "texto_plano").where(F.col("tipo").isin(*NUMERADOS))
    # repeated deliveries collapse on the narrow result; the texts are not shuffled
    return b.select("documento_id", "bloque_id", "tipo", "pagina", numero(F.col("texto_plano")).alias("num")).where("size(num) > 0").distinct()


def huecos_numeracion(n: DataFrame) -> DataFrame:
    """Gaps: consecutive numbers of one type and prefix in a document whose last parts differ by more than one.

    The window is partitioned by document, type and prefix (chapter), never by document
    alone, so a very large document spreads over its chapters.  Equal numbers make no gap.
    """
    prefijo = F.slice("num", 1, F.size("num") - 1)
    n = n.withColumn("prefijo", F.array_join(prefijo.cast("array<string>"), ".")).withColumn("ultimo", F.element_at("num", -1))
    w = Window.partitionBy("documento_id", "tipo", "prefijo").orderBy("ultimo", "bloque_id")
    return n.withColumn("siguiente", F.lead("ultimo").over(w)).where("siguiente - ultimo > 1").select("documento_id", "tipo", "prefijo", F.col("ultimo").alias("desde"), F.col("siguiente").alias("hasta"), "pagina")


def referencias(bloques: DataFrame) -> DataFrame:
    """``(documento_id, bloque_id, pagina, tipo_ref, num_ref)``: references in paragraphs and proofs, one row per mention."""
    b = bloques.select("documento_id", F.col("id").alias("bloque_id"), "pagina", "texto_plano", tipo_normal(F.col("tipo")).alias("tipo")).where("tipo in ('parrafo', 'demostracion')")
    menciones = F.arrays_zip(F.regexp_extract_all("texto_plano", F.lit(REFERENCIA), F.lit(1)).alias("t"), F.regexp_extract_all("texto_plano", F.lit(REFERENCIA), F.lit(2)).alias("n"))
    r = b.select("documento_id", "bloque_id", "pagina", menciones.alias("m")).where("size(m) > 0").distinct().withColumn("r", F.explode("m"))
    return r.select("documento_id", "bloque_id", "pagina", tipo_normal(F.col("r.t")).alias("tipo_ref"), F.col("r.n").alias("num_ref"))


def referencias_colgadas(bloques: DataFrame) -> DataFrame:
    """References to a statement the document does not hold: an anti join on document, type and number."""
    d = numerados(bloques).select("documento_id", F.col("tipo").alias("tipo_ref"), F.array_join(F.col("num").cast("array<string>"), ".").alias("num_ref")).distinct()
    return referencias(bloques).join(d, ["documento_id", "tipo_ref", "num_ref"], "left_anti").select("documento_id", "bloque_id", "pagina", "tipo_ref", "num_ref")


def inconsistencias(bloques: DataFrame) -> DataFrame:
    """``(documento_id, clase, detalle, pagina)``: gaps, then unresolved references (all mentions)."""
    punto = F.when(F.col("prefijo") == "", "").otherwise(F.concat("prefijo", F.lit(".")))
    h = huecos_numeracion(numerados(bloques)).select("documento_id", F.lit("salto_numeracion").alias("clase"), F.concat("tipo", F.lit(" "), punto, F.col("desde"), F.lit(" -> "), punto, F.col("hasta")).alias("detalle"), "pagina")
    r = referencias_colgadas(bloques).select("documento_id", F.lit("referencia_sin_resolver").alias("clase"), F.concat("tipo_ref", F.lit(" "), "num_ref").alias("detalle"), "pagina")
    return h.unionByName(r)


def contexto_de_pagina(bloques: DataFrame, largo: int = 100) -> DataFrame:
    """``(documento_id, pagina, contexto)``: the end of the first block's text, and the beginning of the last one's if there is another; ties by id."""
    t = F.coalesce("texto_plano", F.lit(""))
    lugar = F.struct("orden_lectura", "id")
    # cut first, so whole texts are not shuffled
    b = bloques.select("documento_id", "pagina", lugar.alias("k"), F.right(t, F.lit(largo)).alias("fin"), F.left(t, F.lit(largo)).alias("ini")).distinct()
    g = b.groupBy("documento_id", "pagina").agg(F.count("*").alias("n"), F.min_by("fin", "k").alias("fin"), F.max_by("ini", "k").alias("ini"))
    return g.select("documento_id", "pagina", F.concat("fin", F.when(F.col("n") > 1, F.concat(F.lit("\n"), "ini")).otherwise("")).alias("contexto"))


def paginas_inconsistentes(bloques: DataFrame) -> DataFrame:
    """Blocks on a page with an inconsistency, each once."""
    p = inconsistencias(bloques).select("documento_id", "pagina").distinct()
    return unicos(bloques, "documento_id", "pagina").join(p, ["documento_id", "pagina"], "left_semi").select("documento_id", "pagina", F.col("id").alias("bloque_id"))


def indice_estructural(bloques: DataFrame) -> DataFrame:
    """Summary of the numbered statements per document and kind: how many, first and last number in numerical order."""
    n = numerados(bloques).select("documento_id", F.col("tipo").alias("clase"), "num")
    return n.groupBy("documento_id", "clase").agg(
        F.count("*").alias("n"), F.array_join(F.min("num").cast("array<string>"), ".").alias("primero"), F.array_join(F.max("num").cast("array<string>"), ".").alias("ultimo")
    )


def indice_de_entradas(bloques: DataFrame) -> DataFrame:
    """``(documento_id, clase, posicion, numero, contenido, pagina, bloque_id)``: every heading, statement and proof.

    Headings carry their first 50 characters, statements their number or null; positions
    count from 1 per document and kind, statements by number (none last), then all by place
    and id.  Parts of a number compare by length and digits, so no part is too long.
    """
    tipo, texto = tipo_normal(F.col("tipo")), F.coalesce("texto_plano", F.lit(""))
    partes = F.transform(F.split(F.nullif(F.regexp_extract(texto, r"\d+(?:\.\d+)*", 0), F.lit("")), r"\."), lambda x: F.regexp_replace(x, r"^0+(?=\d)", ""))
    b = bloques.select(
        "documento_id", tipo.alias("clase"), F.when(tipo.isin(*NUMERADOS), F.array_join(partes, ".")).alias("numero"), F.when(tipo == "encabezado", F.substring(texto, 1, 50)).alias("contenido"),
        "pagina", "orden_lectura", F.col("id").alias("bloque_id"),
    ).where(F.col("clase").isin("encabezado", *NUMERADOS, "demostracion")).distinct()
    clave = F.transform(F.split("numero", r"\."), lambda x: F.struct(F.length(x).alias("l"), x.alias("x")))
    w = Window.partitionBy("documento_id", "clase").orderBy(clave.asc_nulls_last(), F.asc_nulls_last("pagina"), F.asc_nulls_last("orden_lectura"), "bloque_id")
    return b.select("documento_id", "clase", F.row_number().over(w).alias("posicion"), "numero", "contenido", "pagina", "bloque_id")


def indice_para_modelo(bloques: DataFrame) -> DataFrame:
    """``(documento_id, clase, numero, pagina, bloque_id, posicion)``: the index that goes into a prompt.

    Theorems, lemmas and definitions that carry a number, as text of two levels at most and
    ordered as text ("10" before "9"), then page (0 and none last), and all proofs.
    """
    tipo = tipo_normal(F.col("tipo"))
    b = bloques.select("documento_id", tipo.alias("clase"), F.when(tipo != "demostracion", numero_corto(F.col("texto_plano"))).alias("numero"), "pagina", F.col("id").alias("bloque_id"))
    b = b.where("clase in ('teorema', 'lema', 'definicion') and numero is not null or clase = 'demostracion'").distinct()
    w = Window.partitionBy("documento_id", "clase").orderBy(F.asc_nulls_last("numero"), F.coalesce(F.nullif("pagina", F.lit(0)), F.lit(999)), "bloque_id")
    return b.withColumn("posicion", F.row_number().over(w))


def _por_trozos(p: DataFrame, d: DataFrame) -> DataFrame:
    """``(palabra, sugerencia)``: every pair within d = m div 5 edits, m >= 15 the length of the longer, and others.

    With i edited pieces before the first unedited one, a shift by t and lengths that differ
    by x: |t| + |x - t| <= d, and |x - t| <= d - i.  Rows are exploded step by step, so that
    no row holds all keys of a very long word.
    """
    corte = "cast(i * n div (d + 1) as int) ini", "cast((i + 1) * n div (d + 1) - i * n div (d + 1) as int) largo"
    q = d.selectExpr("sugerencia", "char_length(sugerencia) n").where("n >= 12")
    # a partner may be longer by a quarter, so d is at most n div 4
    b = q.selectExpr("sugerencia", "n", "explode(sequence(cast(greatest(3, n div 5) as int), cast(n div 4 as int))) d").selectExpr("*", "explode(sequence(0, d)) i").selectExpr("*", *corte)
    b = b.selectExpr("sugerencia", "n", "d", "i", "substring(sugerencia, ini + 1, largo) k")
    # one row per length of the dictionary
    a = p.selectExpr("palabra", "char_length(palabra) l").where("l >= 12").join(F.broadcast(q.select("n").distinct()), F.expr("greatest(l, n) >= 15 and 5 * abs(l - n) <= greatest(l, n)"))
    a = a.selectExpr("palabra", "l", "n", "cast(greatest(l, n) div 5 as int) d").selectExpr("*", "explode(sequence(0, d)) i").selectExpr("*", *corte).selectExpr("*", "explode(sequence(-d, d)) t")
    a = a.where("abs(t) + abs(l - n - t) <= d and abs(l - n - t) <= d - i and ini + t >= 0 and ini + t + largo <= l").selectExpr("palabra", "n", "d", "i", "substring(palabra, ini + t + 1, largo) k").distinct()
    return a.join(b, ["n", "d", "i", "k"]).select("palabra", "sugerencia")


def diccionario(general: DataFrame, tecnico: DataFrame, cual: str = "ambos") -> DataFrame:
    """``(palabra)`` of the general list, the technical one, or both, each once."""
    if cual not in ("general", "tecnico", "ambos"):
        raise ValueError(f"unknown dictionary: {cual}")
    partes = [d.select("palabra") for n, d in (("general", general), ("tecnico", tecnico)) if cual in (n, "ambos")]
    return (partes[0] if len(partes) == 1 else partes[0].unionByName(partes[1])).distinct()


def reparaciones_por_escalar(corregidos: DataFrame) -> DataFrame:
    """``(bloque_id, motivo)`` of ``corregidos(bloque_id, antes, despues, ortografia)``: structures whose repair is ambiguous or still unbalanced, and spelling that changed a word.

    A missing opening sign is put in front, which may be the wrong place, so it goes to the
    language model; so does a text that does not balance after the repair.
    """
    motivos = F.array_compact(F.array(
        F.when(F.coalesce(reparacion_ambigua(F.col("antes")), F.lit(False)), "ambigua"), F.when(~F.coalesce(estructura_valida(F.col("despues")), F.lit(True)), "desequilibrada"), F.when(F.col("ortografia"), "ortografia"),
    ))
    return corregidos.select("bloque_id", F.explode(motivos).alias("motivo"))


def sugerencias(palabras: DataFrame, diccionario: DataFrame) -> DataFrame:
    """``(palabra, sugerencia, distancia)``: the most similar dictionary word at similarity 0.8 or more; ties by alphabet.

    Words of the dictionary drop out.  Candidates meet on equal keys instead of a nested
    loop: at similarity 0.8 two words, the longer of length m, are within d = m div 5
    edits.  Up to 14 characters they share a string left after at most d deletions on each
    side.  Longer pairs share a piece: of d + 1 pieces of the dictionary word one is not
    edited, and the first such piece stands in the other word at a bounded shift.
    """
    p = palabras.select(F.lower("palabra").alias("palabra")).where("palabra <> ''").distinct().join(diccionario.select("palabra").distinct(), "palabra", "left_anti")
    d = diccionario.select(F.lower("palabra").alias("sugerencia")).where("sugerencia <> ''").distinct()

    def vecinos(c: Column) -> Column:
        n = F.length(c)
        sin = lambda x, i: F.overlay(x, F.lit(""), i, F.lit(1))
        quita = F.transform(F.sequence(F.lit(1), n), lambda i: sin(c, i))
        dos = F.flatten(F.transform(quita, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: sin(x, i))))
        return F.array_distinct(F.when(n < 4, F.array(c)).when(n < 9, F.concat(F.array(c), quita)).otherwise(F.concat(F.array(c), quita, dos)))

    a = p.where("char_length(palabra) < 15").withColumn("k", F.explode(vecinos(F.col("palabra"))))
    b = d.where("char_length(sugerencia) < 15").withColumn("k", F.explode(vecinos(F.col("sugerencia"))))
    j = a.join(b, "k").select("palabra", "sugerencia").unionByName(_por_trozos(p, d)).distinct()
    m = F.greatest(F.length("palabra"), F.length("sugerencia"))
    j = j.withColumn("distancia", F.levenshtein("palabra", "sugerencia")).where((5 * F.col("distancia") <= m))
    return j.groupBy("palabra").agg(F.min(F.struct((F.col("distancia") / m).alias("r"), "sugerencia", "distancia")).alias("x")).select("palabra", "x.sugerencia", "x.distancia")
