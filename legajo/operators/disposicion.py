"""Page layout: column street, reading order, zones, merged lines."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.sources.tablas import unicos

PASOS, BANDA, MIN_LADO, MIN_BLOQUES = 30, (0.35, 0.65), 0.2, 4
PAGINA = ["documento_id", "pagina"]


def cajas(bloques: DataFrame) -> DataFrame:
    return unicos(bloques, "documento_id", "pagina", "bbox").select("documento_id", "pagina", F.col("id").alias("bloque_id"), "bbox.*").where("x0 is not null and x1 is not null and y0 is not null")


def calles(c: DataFrame) -> DataFrame:
    """``(documento_id, pagina, calle)`` of pages in two columns.

    31 cuts through the middle band of a page's extent are tried; a cut no box crosses and
    whose smaller side holds a fifth of the boxes qualifies, the most balanced wins, then
    the leftmost.  Counts per page and cut combine map-side; no pairs of boxes are formed.
    """
    e = c.groupBy(*PAGINA).agg(F.min("x0").alias("mn"), F.max("x1").alias("mx"), F.count("*").alias("n")).where((F.col("n") >= MIN_BLOQUES) & (F.col("mx") > F.col("mn")))
    ancho = F.col("mx") - F.col("mn")
    ini, fin = F.col("mn") + ancho * BANDA[0], F.col("mn") + ancho * BANDA[1]
    x = ini + (fin - ini) * F.col("i") / PASOS
    k = c.join(e, PAGINA).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PASOS)))).withColumn("x", x)
    g = k.groupBy(*PAGINA, "i").agg(
        F.first("x").alias("x"), F.first("n").alias("n"), F.count_if((F.col("x0") < F.col("x")) & (F.col("x") < F.col("x1"))).alias("cruzan"), F.count_if(F.col("x1") <= F.col("x")).alias("izq")
    )
    g = g.where("cruzan = 0").withColumn("menor", F.least("izq", F.col("n") - F.col("izq"))).where(F.col("menor") / F.col("n") >= MIN_LADO)
    return g.groupBy(*PAGINA).agg(F.max_by("x", F.struct("menor", -F.col("i"))).alias("calle"))


def orden_de_lectura(bloques: DataFrame) -> DataFrame:
    """``(documento_id, pagina, bloque_id, orden)``: left column before right, top to bottom, left to right, then id."""
    return orden_de_cajas(cajas(bloques))


def orden_de_cajas(c: DataFrame) -> DataFrame:
    j = c.join(calles(c), PAGINA, "left")
    lado = F.when(F.col("calle").isNull(), 0).otherwise((F.col("x1") > F.col("calle")).cast("int"))
    w = Window.partitionBy(*PAGINA).orderBy(lado, "y0", "x0", "bloque_id")
    return j.select(*PAGINA, "bloque_id", (F.row_number().over(w) - 1).alias("orden"))


def lado_de_calle(c: DataFrame, nombre: str) -> DataFrame:
    """Adds ``nombre``: 1 for a box right of the street of its page, else 0; the rule of ``calles`` beside the rows.

    The cuts grow, so a box crosses a run of the 31, from the first right of its left edge
    to the last left of its right edge: the cuts that a page's boxes leave free are one OR
    over the runs.  Only pages with a free cut count the boxes left of it.  Rows that were
    costly to get are read once and carry what else they hold.
    """
    w = Window.partitionBy(*PAGINA)
    c = c.withColumns({"_mn": F.min("x0").over(w), "_mx": F.max("x1").over(w), "_n": F.count("*").over(w)})
    c = c.withColumns({k: F.col("_mn") + (F.col("_mx") - F.col("_mn")) * v for k, v in zip(("_ini", "_fin"), BANDA)})
    corte = lambda i: F.col("_ini") + (F.col("_fin") - F.col("_ini")) * i / PASOS
    cortes = [corte(F.lit(i)) for i in range(PASOS + 1)]
    c = c.withColumns({"_a": reduce(add, [(x <= F.col("x0")).cast("int") for x in cortes]), "_b": reduce(add, [(x < F.col("x1")).cast("int") for x in cortes])})
    c = c.withColumn("_r", F.expr("if(_b > _a, shiftleft(1L, _b) - shiftleft(1L, _a), 0L)"))
    c = c.withColumns({"_r": F.coalesce(F.bit_or("_r").over(w), F.lit(0)), "_bs": F.collect_list("_b").over(w)})
    libres = F.filter(F.sequence(F.lit(0), F.lit(PASOS)), lambda i: F.getbit("_r", i) == 0)
    izq = lambda i: F.size(F.filter("_bs", lambda b: b <= i))
    mejor = F.array_max(F.transform(libres, lambda i: F.struct(F.least(izq(i), F.col("_n") - izq(i)).alias("menor"), (-i).alias("i"), corte(i).alias("x"))))
    hay = (F.col("_n") >= MIN_BLOQUES) & (F.col("_mx") > F.col("_mn")) & (F.col("_r") != 2 ** (PASOS + 1) - 1)
    c = c.withColumn("_m", F.when(hay, mejor)).withColumn("_calle", F.when(F.col("_m.menor") / F.col("_n") >= MIN_LADO, F.col("_m.x")))
    c = c.withColumn(nombre, F.when(F.col("_calle").isNull(), 0).otherwise((F.col("x1") > F.col("_calle")).cast("int")))
    return c.drop("_mn", "_mx", "_n", "_ini", "_fin", "_a", "_b", "_r", "_bs", "_m", "_calle")


def renglones(c: DataFrame, tolerancia: float = 0.5) -> DataFrame:
    """Visual rows of a page: a box joins the row before it if its top is within half that box's height.

    ``(documento_id, pagina, renglon, n, x0, y0, x1, y1)`` with the merged box.
    """
    w = Window.partitionBy(*PAGINA).orderBy("y0", "x0", "bloque_id")
    c = c.withColumn("nuevo", F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(w)) > tolerancia * (F.lag("y1").over(w) - F.lag("y0").over(w))).cast("int"), F.lit(1)))
    c = c.withColumn("renglon", F.sum("nuevo").over(w) - 1)
    return c.groupBy(*PAGINA, "renglon").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def perfil_de_paginas(bloques: DataFrame) -> DataFrame:
    """``(documento_id, pagina, n, formula, tabla, figura, perfil, ocr, dpi)`` from the blocks of each page.

    The dominant profile is the largest of text, formula, table and figure share, the first
    on a tie.  A native page without formulas needs 200 dpi, with formulas 300; a scanned
    one 400 with many formulas, 300 with tables, else 200.
    """
    from legajo.functions.texto import tipo_normal

    b = unicos(bloques, "documento_id", "pagina", "tipo", "origen_contenido").withColumn("tipo", tipo_normal(F.col("tipo")))
    g = b.groupBy(*PAGINA).agg(
        F.count("*").alias("n"), F.count_if(F.col("tipo").isin("formula_display", "formula_inline")).alias("formula"), F.count_if(F.col("tipo") == "tabla").alias("tabla"),
        F.count_if(F.col("tipo") == "figura").alias("figura"), F.max(F.col("origen_contenido") == "requiere_ocr").alias("ocr"),
    )
    texto = F.col("n") - F.col("formula") - F.col("tabla") - F.col("figura")
    candidatos = F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(nombre).alias("p")) for i, (v, nombre) in enumerate([(texto, "texto"), (F.col("formula"), "formula"), (F.col("tabla"), "tabla"), (F.col("figura"), "figura")])])
    dpi = (
        F.when(~F.col("ocr"), F.when(F.col("formula") > 0, 300).otherwise(200))
        .when(10 * F.col("formula") > 3 * F.col("n"), 400).when(5 * F.col("tabla") > F.col("n"), 300).otherwise(200)
    )
    return g.withColumn("perfil", F.array_max(candidatos)["p"]).withColumn("dpi", dpi)


def con_dpi(filas: DataFrame, dpi: DataFrame, otro: int = 200) -> DataFrame:
    """Rows with the resolution of their page, ``otro`` for a page without one."""
    return filas.join(dpi.select(*PAGINA, "dpi"), PAGINA, "left").withColumn("dpi", F.coalesce("dpi", F.lit(otro)))


def zonas(p: DataFrame) -> DataFrame:
    """Contiguous pages with equal resolution and profile: gaps and islands over the pages of a document."""
    w = Window.partitionBy("documento_id").orderBy("pagina")
    cambia = F.coalesce(((F.lag("dpi").over(w) != F.col("dpi")) | (F.lag("perfil").over(w) != F.col("perfil")) | (F.lag("pagina").over(w) != F.col("pagina") - 1)).cast("int"), F.lit(1))
    z = p.withColumn("c", cambia).withColumn("zona", F.sum("c").over(w))
    return z.groupBy("documento_id", "zona").agg(F.min("pagina").alias("desde"), F.max("pagina").alias("hasta"), F.first("dpi").alias("dpi"), F.first("perfil").alias("perfil"))
