"""Native page text: spans to runs, lines, paragraphs and blocks.

Inputs are span or line tables; a page (``documento_id, pagina``) is the unit of every
window, so a very large document spreads over its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.geometria import normalizar
from legajo.functions.texto import clasificar, limpiar, recortar
from legajo.sources.tablas import fijar

PAGINA = ["documento_id", "pagina"]
# --- fixed values: typographic signals ----------------------------------------------------------
FUENTES_MATEMATICAS = r"(?i)^(?:[A-Z]{6}\+)?.*(CMMI|CMSY|CMEX|MSAM|MSBM|MTMI|MTSY|MTEX|MTGU|MTSYN|Symbol|Latin Modern Math)"
NEGRITA = r"(?i)bold|black|heavy|semibold|demi|[-,]b$|[-,]bd$"
CURSIVA = r"(?i)italic|oblique|[-,]i$|[-,]it$"
PUNTOS_GUIA = r"\.(?:\s*\.){3,}"
VINETA = r"^(?:[•·▪‣◦∙]|\d{1,3}[.)]\s)"
SANGRIA, SALTO_LINEA, SALTO_TAMANO, BANDA, TAMANO_INDICE, DESPLAZAMIENTO = 3.0, 1.45, 0.6, 0.09, 0.9, 0.12
PALABRA = r"(?U)[^\W\d_]+(?:['’][^\W\d_]+)*"
# --- end of fixed values ------------------------------------------------------------------------


def es_matematica(fuente: Column) -> Column:
    return fuente.rlike(FUENTES_MATEMATICAS)


def es_negrita(fuente: Column, marcas: Column) -> Column:
    return (marcas.bitwiseAND(16) != 0) | fuente.rlike(NEGRITA)


def es_cursiva(fuente: Column, marcas: Column) -> Column:
    return (marcas.bitwiseAND(2) != 0) | fuente.rlike(CURSIVA)


def es_indice(tamano: Column, tamano_linea: Column, centro: Column, centro_linea: Column) -> Column:
    """Super- or subscript: clearly smaller than its line and off its centre."""
    return (tamano < TAMANO_INDICE * tamano_linea) & (F.abs(centro - centro_linea) > DESPLAZAMIENTO * tamano_linea)


def tamano_cuerpo(filas: DataFrame) -> DataFrame:
    """``(documento_id, pagina, cuerpo)``: the size that most characters have, rounded to a tenth; the first seen wins a tie."""
    g = filas.withColumn("t", F.round("tamano", 1)).groupBy(*PAGINA, "t").agg(F.sum(F.length("texto")).alias("n"), F.min("seq").alias("s"))
    return g.groupBy(*PAGINA).agg(F.max_by("t", F.struct("n", -F.col("s"))).alias("cuerpo"))


def margen_modal(filas: DataFrame) -> DataFrame:
    """``(documento_id, pagina, margen)``: the commonest left edge, the leftmost on a tie."""
    g = filas.withColumn("x", F.round("x0")).groupBy(*PAGINA, "x").count()
    return g.groupBy(*PAGINA).agg(F.max_by("x", F.struct("count", -F.col("x"))).alias("margen"))


def tramos(spans: DataFrame) -> DataFrame:
    """Runs of consecutive spans of a line that are all formula or all text: ``(…, linea, tramo, formula, texto, x0, y0, x1, y1)``.

    ``spans(documento_id, pagina, linea, seq, texto, formula, x0, y0, x1, y1)``.
    """
    w = Window.partitionBy(*PAGINA, "linea").orderBy("seq")
    s = spans.withColumn("c", F.coalesce((F.lag("formula").over(w) != F.col("formula")).cast("int"), F.lit(1))).withColumn("tramo", F.sum("c").over(w) - 1)
    texto = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "texto"))), lambda x: x["texto"]), "")
    return s.groupBy(*PAGINA, "linea", "tramo").agg(F.first("formula").alias("formula"), texto.alias("texto"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def filas(lineas: DataFrame) -> DataFrame:
    """Lines that share a visual row merged: box, text by x, style of most characters.

    ``lineas(documento_id, pagina, bloque, seq, texto, x0, y0, x1, y1, tamano, negrita)``, and
    both of ``palabras`` (words of a line; null: those of its text) and ``cuerpo``, or neither.
    """
    w = Window.partitionBy(*PAGINA, "bloque").orderBy("y0", "x0", "seq")
    s = lineas.withColumn("c", F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(w)) > 0.5 * (F.lag("y1").over(w) - F.lag("y0").over(w))).cast("int"), F.lit(1))).withColumn("fila", F.sum("c").over(w) - 1)
    con = [c for c in ("palabras", "cuerpo") if c in lineas.columns]
    piezas = F.array_sort(F.collect_list(F.struct("x0", "seq", "texto", *con[:1])))
    texto = F.array_join(F.transform(piezas, lambda x: x["texto"]), " ")
    n, marcados = F.sum(F.length("texto")), F.sum(F.when(F.col("negrita"), F.length("texto")).otherwise(0))
    otras = [F.when(F.max(F.col("palabras").isNotNull()), F.array_join(F.transform(piezas, lambda x: F.coalesce(x["palabras"], x["texto"])), " ")).alias("palabras"), F.first("cuerpo").alias("cuerpo")] if len(con) == 2 else []
    return s.groupBy(*PAGINA, "bloque", "fila").agg(
        F.min("seq").alias("seq"), texto.alias("texto"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("tamano").alias("tamano"), ((n > 0) & (2 * marcados >= n)).alias("negrita"), *otras
    )


def parrafos(f: DataFrame) -> DataFrame:
    """Adds ``parrafo`` to rows: a new one at a wide gap, an indent, a bullet, a jump in size, or leader dots here or before."""
    w = Window.partitionBy(*PAGINA, "bloque").orderBy("fila")
    todo = Window.partitionBy(*PAGINA, "bloque")
    # margen_modal beside its rows, so that they are not computed twice
    s = f.withColumn("_x", F.round("x0")).withColumn("_n", F.count("*").over(Window.partitionBy(*PAGINA, "_x")))
    s = s.withColumn("margen", F.max_by("_x", F.struct("_n", -F.col("_x"))).over(Window.partitionBy(*PAGINA))).drop("_x", "_n")
    s = s.withColumn("hueco", F.col("y0") - F.lag("y0").over(w))
    s = s.withColumn("mediana", F.median("hueco").over(todo))
    guia = F.col("texto").rlike(PUNTOS_GUIA)
    corta = (
        (F.col("hueco") > SALTO_LINEA * F.col("mediana")) | (F.col("x0") > F.col("margen") + SANGRIA) | F.col("texto").rlike(VINETA)
        | (F.abs(F.col("tamano") - F.lag("tamano").over(w)) > SALTO_TAMANO) | guia | F.lag(guia).over(w)
    )
    s = s.withColumn("c", F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(corta, F.lit(False)).cast("int")))
    return s.withColumn("parrafo", F.sum("c").over(w) - 1).drop("c", "hueco", "mediana", "margen")


def es_ruido(texto: Column, tamano: Column, cuerpo: Column, y0: Column, y1: Column, alto: Column) -> Column:
    """Running header or page number: short, small, in the top or bottom band."""
    return (F.length(texto) <= 80) & (tamano <= 0.95 * cuerpo) & ((y1 <= BANDA * alto) | (y0 >= (1 - BANDA) * alto))


def cortes_de_lineas(lineas: DataFrame, *orden: str) -> DataFrame:
    """Adds ``cortada``: a hyphen cuts the line (null for a blank one), and ``antes``: the last line before it on its page that is not blank is cut."""
    w = Window.partitionBy(*PAGINA).orderBy(*orden).rowsBetween(Window.unboundedPreceding, -1)
    t = recortar(F.col("texto"))
    s = lineas.withColumn("cortada", F.when(t == "", None).otherwise(t.rlike("[-­]$")))
    return s.withColumn("antes", F.coalesce(F.last("cortada", ignorenulls=True).over(w), F.lit(False)))


def palabras_enteras() -> Column:
    """The words of a line of ``cortes_de_lineas`` without the halves of divided ones: not its last word if it is cut, not its first if the line before is."""
    p = F.regexp_extract_all(F.lower(recortar(F.col("texto"))), F.lit(PALABRA), F.lit(0))
    desde, fuera = F.when(F.col("antes"), 2).otherwise(1), F.when(F.col("cortada"), 1).otherwise(0)
    return F.slice(p, desde, F.greatest(F.lit(0), F.size(p) - fuera - desde + 1))


def palabras_de_lineas(lineas: DataFrame) -> DataFrame:
    """Adds ``q``: the words of each line without the halves of divided ones.

    The last word of a line cut by a hyphen and the first of the next line that is not
    blank are left out; blank lines do not end the cut.
    """
    return cortes_de_lineas(lineas, "seq").withColumn("q", palabras_enteras()).drop("cortada", "antes")


def vocabulario(lineas: DataFrame) -> DataFrame:
    """``(documento_id, palabra)``: distinct words without the halves of divided ones."""
    return palabras_de_lineas(lineas).select("documento_id", F.explode("q").alias("palabra")).distinct()


def unir_filas(textos: Column, vocabulario_: Column) -> Column:
    """Fold an ordered array of row texts: a soft hyphen always joins; a hyphen joins without itself unless both halves are words of the vocabulary or no words."""

    def paso(a: Column, x: Column) -> Column:
        izq = F.regexp_extract(a, r"(?U)([^\W\d_]+)-$", 1)
        der = F.regexp_extract(x, r"(?U)^([^\W\d_]+)", 1)
        ambas = F.array_contains(vocabulario_, F.lower(izq)) & F.array_contains(vocabulario_, F.lower(der))
        sin = F.concat(F.regexp_replace(a, ".$", ""), x)
        return F.when(a == "", x).when(x == "", a).when(a.endswith("­"), sin).when(a.endswith("-"), F.when((izq == "") | (der == "") | ambas, F.concat(a, x)).otherwise(sin)).otherwise(F.concat(a, F.lit(" "), x))

    return F.aggregate(F.transform(textos, recortar), F.lit(""), paso)


LINEA = [*PAGINA, "bloque", "linea"]
SPAN = ["seq", "texto", "fuente", "marcas", "tamano", "x0", "y0", "x1", "y1"]


def tamano_dominante(spans: DataFrame) -> DataFrame:
    """``(documento_id, pagina, bloque, linea, cuerpo)``: the size that most characters of a line have; the first seen wins a tie."""
    g = spans.withColumn("t", F.round("tamano", 1)).groupBy(*LINEA, "t").agg(F.sum(F.length("texto")).alias("n"), F.min("seq").alias("s"))
    return g.groupBy(*LINEA).agg(F.max_by("t", F.struct("n", -F.col("s"))).alias("cuerpo"))


def centro_dominante(spans: DataFrame, cuerpo: DataFrame) -> DataFrame:
    """``(documento_id, pagina, bloque, linea, centro)``: mean vertical centre of the spans of the line's size, of all if there is none."""
    c = (F.col("y0") + F.col("y1")) / 2
    j = spans.join(cuerpo, LINEA)
    return j.groupBy(*LINEA).agg(F.coalesce(F.avg(F.when(F.abs(F.col("tamano") - F.col("cuerpo")) < 0.05, c)), F.avg(c)).alias("centro"))


def marcar(spans: DataFrame) -> DataFrame:
    """Adds ``formula``, ``negrita``, ``cursiva``: by font name and flags, or as an index raised or lowered from its line."""
    cuerpo = tamano_dominante(spans)
    j = spans.join(cuerpo, LINEA).join(centro_dominante(spans, cuerpo), LINEA)
    indice = es_indice(F.col("tamano"), F.col("cuerpo"), (F.col("y0") + F.col("y1")) / 2, F.col("centro"))
    return j.withColumns({"formula": es_matematica(F.col("fuente")) | indice, "negrita": es_negrita(F.col("fuente"), F.col("marcas")), "cursiva": es_cursiva(F.col("fuente"), F.col("marcas"))}).drop("centro")


def fuentes_matematicas(spans: DataFrame) -> DataFrame:
    """``(documento_id, pagina, fuentes)``: the mathematical fonts of each page by full name, in alphabetical order."""
    return spans.where(es_matematica(F.col("fuente"))).groupBy(*PAGINA).agg(F.array_sort(F.collect_set("fuente")).alias("fuentes"))


def lineas_de_spans(marcados: DataFrame) -> DataFrame:
    """Lines of marked spans: text in order, box, dominant size, bold if most characters are."""
    n, m = F.sum(F.length("texto")), F.sum(F.when(F.col("negrita"), F.length("texto")).otherwise(0))
    texto = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "texto"))), lambda x: x["texto"]), "")
    return marcados.groupBy(*LINEA).agg(
        F.min("seq").alias("seq"), limpiar(texto).alias("texto"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("cuerpo").alias("tamano"), ((n > 0) & (2 * m >= n)).alias("negrita")
    )


def lineas_de_pagina(spans: DataFrame) -> DataFrame:
    """The rows of ``lineas_de_spans(marcar(spans))`` in one pass over the spans, which are gathered by line."""
    s = spans.dropna(subset=LINEA).groupBy(*LINEA).agg(F.sort_array(F.collect_list(F.struct(*SPAN))).alias("s"))
    return lineas_de_renglones(s.select(*LINEA, *[F.col("s")[c].alias(c) for c in SPAN]))


def lineas_de_renglones(renglones: DataFrame) -> DataFrame:
    """The rows of ``lineas_de_pagina`` for spans that come within their lines, as in a PDF; no span becomes a row.

    ``renglones(documento_id, pagina, bloque, linea, seq, texto, fuente, marcas, tamano, x0,
    y0, x1, y1)``: one row for a line, from ``seq`` on arrays over its spans, one at least, in
    order.  The marks of single spans (formula, italic) do not count for a line.
    """
    r = renglones.dropna(subset=LINEA).withColumns({"_c": F.array_join("texto", ""), "_t": F.array_distinct("tamano"), "_f": F.array_distinct("fuente"), "_m": F.array_distinct("marcas")})
    # most lines have one size and one font; spans are looked at one by one in the others
    r = r.withColumn("_z", F.when((F.size("_t") > 1) | (F.size("_f") > 1) | (F.size("_m") > 1), F.arrays_zip(*SPAN[:5])))
    largo = lambda s: F.length(s["texto"]).cast("bigint")
    suma = lambda xs, de_uno: F.aggregate(xs, F.lit(None).cast("bigint"), lambda n, s: F.coalesce(n + de_uno(s), n, de_uno(s)))
    con_tamano = lambda t: F.filter("_z", lambda s: F.round(s["tamano"], 1).eqNullSafe(t))
    tamanos = F.transform(F.array_distinct(F.transform("_t", lambda t: F.round(t, 1))), lambda t: F.struct(suma(con_tamano(t), largo).alias("n"), (-F.array_min(con_tamano(t)["seq"])).alias("s"), t.alias("t")))
    tamano = F.when(F.size("_t") == 1, F.round(F.col("_t")[0], 1)).otherwise(F.array_max(tamanos)["t"])
    marcados = F.when((F.size("_f") == 1) & (F.size("_m") == 1), F.when(es_negrita(F.col("_f")[0], F.col("_m")[0]), F.length("_c").cast("bigint")).otherwise(F.lit(0)))
    marcados = marcados.otherwise(suma(F.col("_z"), lambda s: F.when(es_negrita(s["fuente"], s["marcas"]), largo(s)).otherwise(F.lit(0))))
    cajas = [f(c).alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))]
    r = r.withColumns({"_d": tamano, "_b": (F.length("_c") > 0) & (2 * marcados >= F.length("_c"))})
    return r.select(*LINEA, F.array_min("seq").alias("seq"), limpiar(F.col("_c")).alias("texto"), *cajas, F.col("_d").alias("tamano"), F.col("_b").alias("negrita"))


def divisiones(filas_: DataFrame) -> DataFrame:
    """Adds ``sigue`` to the rows of paragraphs: how a row goes on, and the halves ``izq``, ``der`` where the vocabulary decides (``par``).

    ``fin``: the last row; ``sin``: without its hyphen; ``pegado``: as it stands;
    ``espacio``: with a space.  Blank rows drop out.
    """
    # a paragraph is a run of rows, so the row after is looked for in the order that its rows already have
    w = Window.partitionBy(*PAGINA, "bloque").orderBy("fila")
    f = filas_.withColumn("texto", recortar(F.col("texto"))).where("texto <> ''").withColumn("_s", F.when(F.lead("parrafo").over(w) == F.col("parrafo"), F.lead("texto").over(w)))
    guion = F.col("texto").endswith("-") & F.col("_s").isNotNull()
    halla = lambda c, p: F.when(guion, F.lower(F.nullif(F.regexp_extract(c, p, 1), F.lit(""))))
    antes, despues = r"(?U)([^\W\d_]+)-$", r"(?U)^([^\W\d_]+)"
    f = f.withColumns({"izq": halla(F.col("texto"), antes), "der": halla(F.col("_s"), despues)})
    sigue = F.when(F.col("_s").isNull(), "fin").when(F.col("texto").endswith("­"), "sin").when(F.col("texto").endswith("-"), F.when(F.col("izq").isNull() | F.col("der").isNull(), "pegado").otherwise("par")).otherwise("espacio")
    f = f.withColumn("sigue", sigue).drop("_s")
    return f.withColumns({c: F.when(F.col("sigue") == "par", F.col(c)) for c in ("izq", "der")})


def posibles(palabras: DataFrame, mitades: DataFrame) -> DataFrame:
    """``(documento_id, palabra)``: the rows of ``palabras`` that may be among ``mitades``, and few others.

    A bitmap of 2^26 places (at most 2^20 rows of 64, broadcast) lets every word of
    ``mitades`` through, so the rest of a vocabulary is never shuffled.
    """
    lugar = F.shiftrightunsigned(F.xxhash64("documento_id", "palabra"), 38)
    m = mitades.select(lugar.alias("_l")).groupBy(F.shiftright("_l", 6).alias("_g")).agg(F.expr("bit_or(shiftleft(1L, cast(_l & 63 as int)))").alias("_b"))
    j = palabras.select("documento_id", "palabra", lugar.alias("_l"), F.shiftright(lugar, 6).alias("_g")).join(F.broadcast(m), "_g")
    return j.where(F.getbit("_b", F.col("_l").bitwiseAND(63)) == 1).select("documento_id", "palabra")


def pares_propios(pares: DataFrame, palabras: DataFrame) -> DataFrame:
    """The rows of ``pares(documento_id, izq, der)``, once each, of which both halves are words of the document (``palabras(documento_id, palabra)``)."""
    pares = pares.select("documento_id", "izq", "der").distinct()
    v = posibles(palabras, pares.select("documento_id", F.explode(F.array("izq", "der")).alias("palabra"))).distinct()
    return pares.join(v.withColumnRenamed("palabra", "izq"), ["documento_id", "izq"], "left_semi").join(v.withColumnRenamed("palabra", "der"), ["documento_id", "der"], "left_semi")


def bloques_de_paginas(spans: DataFrame, paginas: DataFrame) -> DataFrame:
    """``bloques_de_lineas`` of flat spans.

    ``spans(documento_id, pagina, bloque, linea, seq, texto, fuente, marcas, tamano, x0, y0,
    x1, y1)``.
    """
    return bloques_de_lineas(lineas_de_pagina(spans), paginas)


def bloques_de_lineas(lineas: DataFrame, paginas: DataFrame) -> DataFrame:
    """``(documento_id, pagina, bloque, parrafo, orden, tipo, texto, bbox, origen_contenido)``: native pages cut into blocks.

    ``lineas`` as of ``lineas_de_pagina``, ``paginas(documento_id, pagina, ancho, alto)``.
    Lines are joined to visual rows, rows to paragraphs; divided words are joined: a soft
    hyphen at a row's end joins, a hyphen joins without itself unless both halves are words
    of the document or one is no word; a single row in the margin is noise, leader dots make
    an entry of an index, all else is classified by its text, weight and size; blocks are
    put in reading order.
    """
    from legajo.operators.disposicion import lado_de_calle

    # all that a page tells by itself comes first; lines stand by block and place in it, as seq may start anew in every block
    pag, parrafo = Window.partitionBy(*PAGINA), [*PAGINA, "bloque", "parrafo"]
    l = cortes_de_lineas(lineas.withColumns({"_l": F.row_number().over(pag.orderBy("bloque", "linea")), "_t": F.round("tamano", 1)}), "bloque", "linea")
    l = l.withColumn("palabras", F.when(F.col("antes") | F.coalesce("cortada", F.lit(False)), F.array_join(palabras_enteras(), " ")))
    de_tamano = Window.partitionBy(*PAGINA, "_t")
    l = l.withColumns({"_n": F.sum(F.length("texto")).over(de_tamano), "_p": F.min("_l").over(de_tamano)}).withColumn("cuerpo", F.max_by("_t", F.struct("_n", -F.col("_p"))).over(pag))  # tamano_cuerpo
    f = divisiones(parrafos(filas(l)))
    pieza = F.when(F.col("sigue") == "sin", F.regexp_replace("texto", ".$", "")).when(F.col("sigue") == "espacio", F.concat("texto", F.lit(" "))).otherwise(F.col("texto"))
    g = f.withColumn("pieza", pieza).groupBy(*parrafo).agg(
        F.array_sort(F.collect_list(F.struct("fila", "pieza", "palabras", "izq", "der"))).alias("piezas"), F.max(F.col("sigue") == "par").alias("_par"), F.max(F.col("palabras").isNotNull()).alias("_v"),
        F.count("*").alias("filas"), F.min_by("negrita", "fila").alias("negrita"), F.max("tamano").alias("tamano"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("cuerpo").alias("cuerpo"),
    )
    # a paragraph has its text, or its pieces if the vocabulary decides on one; palabras: its words where they are not those of the text
    g = g.withColumns({
        "texto": F.when(~F.col("_par"), F.array_join(F.col("piezas")["pieza"], "")), "palabras": F.when(F.col("_v"), F.array_join(F.transform("piezas", lambda x: F.coalesce(x["palabras"], x["pieza"])), " ")),
        "piezas": F.when(F.col("_par"), F.transform("piezas", lambda x: F.struct(x["pieza"].alias("pieza"), x["izq"].alias("izq"), x["der"].alias("der")))),
    })
    j = g.join(paginas, PAGINA)
    # a single row is no divided one, so its text is known
    ruido = (F.col("filas") == 1) & es_ruido(F.col("texto"), F.col("tamano"), F.col("cuerpo"), F.col("y0"), F.col("y1"), F.col("alto"))
    caja = [normalizar(F.col(c), F.col(m)).alias(c) for c, m in (("x0", "ancho"), ("y0", "alto"), ("x1", "ancho"), ("y1", "alto"))]
    b = j.select(*parrafo, "texto", "piezas", "palabras", "filas", "negrita", (F.col("tamano") / F.nullif("cuerpo", F.lit(0.0))).alias("escala"), ruido.alias("ruido"), *caja)
    o = pag.orderBy("_lado", "y0", "x0", "bloque", "parrafo")
    b = fijar(lado_de_calle(b, "_lado").withColumn("orden", F.row_number().over(o) - 1).drop("_lado"))
    # only paragraphs whose text the vocabulary decides move from here on
    con = b.where("piezas is not null")
    m = con.select(*parrafo, F.explode(F.filter("piezas", lambda x: x["izq"].isNotNull())).alias("q")).select(*parrafo, "q.izq", "q.der")
    v = b.select("documento_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("palabras", "texto")), F.lit(PALABRA), F.lit(0))).alias("palabra"))
    u = m.join(pares_propios(m, v), ["documento_id", "izq", "der"], "left_semi").groupBy(*parrafo).agg(F.collect_set(F.struct("izq", "der")).alias("_u"))
    entera = lambda x: x["izq"].isNull() | F.coalesce(F.array_contains("_u", F.struct(x["izq"].alias("izq"), x["der"].alias("der"))), F.lit(False))
    texto = F.array_join(F.transform("piezas", lambda x: F.when(entera(x), x["pieza"]).otherwise(F.regexp_replace(x["pieza"], ".$", ""))), "")
    con = con.join(u, parrafo, "left").withColumn("texto", texto)
    r = b.where("piezas is null").select(*b.columns).unionByName(con.select(*b.columns))
    guia = F.col("texto").rlike(PUNTOS_GUIA)
    t = F.when(guia & ~F.col("ruido"), limpiar(F.regexp_replace("texto", PUNTOS_GUIA, " … "))).otherwise(F.col("texto"))
    tipo = F.when(F.col("ruido"), "ruido").when(guia, "lista").otherwise(clasificar(F.col("texto"), F.col("negrita"), F.col("escala"), F.col("filas")))
    return r.select(*parrafo, "orden", tipo.alias("tipo"), t.alias("texto"), F.struct("x0", "y0", "x1", "y1").alias("bbox"), F.lit("texto_nativo").alias("origen_contenido"))


def segmentos_de_parrafo(tramos_: DataFrame) -> DataFrame:
    """``(documento_id, pagina, bloque, parrafo, segmentos)``: text and formula segments of a paragraph in order.

    ``tramos_(documento_id, pagina, bloque, parrafo, fila, tramo, formula, texto)``.  Text goes
    on from one row to the next as in ``uniones`` without a vocabulary (a hyphen drops out);
    formulas stay apart.
    """
    w = Window.partitionBy(*PAGINA, "bloque", "parrafo").orderBy("fila", "tramo")
    t = tramos_.where("texto <> ''").withColumn("_c", F.coalesce((F.col("formula") | F.lag("formula").over(w)).cast("int"), F.lit(1))).withColumn("_k", F.sum("_c").over(w)).withColumn("_f", F.lead("fila").over(w)).withColumn("_n", F.lead("_k").over(w))
    otra = (F.col("_n") == F.col("_k")) & (F.col("_f") != F.col("fila"))
    x = F.when(F.coalesce(otra, F.lit(False)), F.when(F.col("texto").rlike("[-­]$"), F.regexp_replace("texto", ".$", "")).otherwise(F.concat("texto", F.lit(" ")))).otherwise(F.col("texto"))
    g = t.groupBy(*PAGINA, "bloque", "parrafo", "_k").agg(F.first("formula").alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fila", "tramo", x.alias("x")))), lambda y: y["x"]), "").alias("texto"))
    s = F.transform(F.array_sort(F.collect_list(F.struct("_k", F.when(F.col("f"), "formula").otherwise("texto").alias("tipo"), "texto"))), lambda y: F.struct(y["tipo"].alias("tipo"), y["texto"].alias("texto")))
    return g.groupBy(*PAGINA, "bloque", "parrafo").agg(s.alias("segmentos"))
