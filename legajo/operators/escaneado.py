"""Scanned pages: regions and components as tables of boxes; pixels are not read here.

A page is the unit of every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.geometria import desnormalizar
from legajo.functions.texto import recortar

PAGINA = ["documento_id", "pagina"]
# --- fixed values: limits of regions and components ------------------------------------------------
TITULO_ALTO, TITULO_ANCHO, TITULO_ARRIBA = 0.02, 0.25, 0.2
MIN_ANCHO, MIN_ALTO, ALTO_PIXELES, MAX_AREA, POCA_TINTA = 0.04, 0.004, 8, 0.9, 0.05
MIN_AREA, ALTA, BAJA, COMPACTA, ANGOSTA, LARGA = 10, 1.8, 0.35, 0.4, 0.3, 3
SALTO, MIN_COMPONENTES, MARGEN = 20, 2, 5
# --- end of fixed values ---------------------------------------------------------------------------


def regiones_con_texto(regiones: DataFrame) -> DataFrame:
    """``regiones(documento_id, pagina, orden, x0, y0, x1, y1, texto, ancho, alto)`` of a recogniser with ``tipo``; regions without text drop out.

    A low and wide line near the top of the page is a heading, all else a paragraph.
    """
    titulo = (F.col("y1") - F.col("y0") <= TITULO_ALTO * F.col("alto")) & (F.col("x1") - F.col("x0") > TITULO_ANCHO * F.col("ancho")) & (F.col("y0") < TITULO_ARRIBA * F.col("alto"))
    r = regiones.withColumn("texto", recortar(F.col("texto"))).where("texto <> ''")
    return r.withColumn("tipo", F.when(titulo, "encabezado").otherwise("parrafo"))


def regiones_por_forma(cajas: DataFrame) -> DataFrame:
    """``cajas(documento_id, pagina, x, y, w, h, densidad, ancho, alto)`` that may be blocks, with ``tipo`` and ``orden`` (top to bottom, left to right).

    Specks, scan borders and the page itself drop out; hardly any ink is a figure, a low and
    wide box a heading.
    """
    min_alto = F.greatest(F.lit(float(ALTO_PIXELES)), MIN_ALTO * F.col("alto"))
    c = cajas.where((F.col("w") >= MIN_ANCHO * F.col("ancho")) & (F.col("h") >= min_alto) & (F.col("w") * F.col("h") <= MAX_AREA * F.col("ancho") * F.col("alto")))
    tipo = F.when(F.col("densidad") < POCA_TINTA, "figura").when((F.col("h") <= 2.5 * min_alto) & (F.col("w") > TITULO_ANCHO * F.col("ancho")), "encabezado").otherwise("parrafo")
    w = Window.partitionBy(*PAGINA).orderBy("y", "x", "w", "h")
    return c.withColumn("tipo", tipo).withColumn("orden", F.row_number().over(w) - 1)


def regiones_simples(contornos: DataFrame) -> DataFrame:
    """Contours whose area lies between 1 and 90 % of the page, top to bottom, left to right: the last resort."""
    pagina = F.col("ancho") * F.col("alto")
    w = Window.partitionBy(*PAGINA).orderBy("y", "x", "w", "h")
    return contornos.where((F.col("area") > 0.01 * pagina) & (F.col("area") < 0.9 * pagina)).withColumn("orden", F.row_number().over(w) - 1)


def segmentar(principal: DataFrame, respaldo: DataFrame) -> DataFrame:
    """Regions of the recogniser; pages where it gave none take those found by form."""
    comunes = [c for c in principal.columns if c in respaldo.columns]
    return principal.select(*comunes).unionByName(respaldo.join(principal.select(*PAGINA).distinct(), PAGINA, "left_anti").select(*comunes))


def componentes(contornos: DataFrame) -> DataFrame:
    """``contornos(documento_id, pagina, bloque_id, id, x, y, w, h, area)`` without specks, with ``es_formula``.

    A component is of a formula if its height departs from the block's median, it fills its
    box and is very narrow or very long.
    """
    c = contornos.where(F.col("area") >= MIN_AREA)
    c = c.join(c.groupBy(*PAGINA, "bloque_id").agg(F.median("h").alias("tipico")), [*PAGINA, "bloque_id"])
    caja, aspecto = F.col("w") * F.col("h"), F.when(F.col("h") > 0, F.col("w") / F.nullif("h", F.lit(0))).otherwise(0.0)
    compacta = F.when(caja > 0, F.col("area") / F.nullif(caja, F.lit(0))).otherwise(0.0)
    desviada = (F.col("h") > ALTA * F.col("tipico")) | (F.col("h") < BAJA * F.col("tipico"))
    return c.withColumn("es_formula", desviada & (compacta > COMPACTA) & ((aspecto < ANGOSTA) | (aspecto > LARGA))).drop("tipico")


def lineas(c: DataFrame) -> DataFrame:
    """Adds ``linea``: from top to bottom, a new one where a component starts more than 20 pixels from the middle of the one before."""
    w = Window.partitionBy(*PAGINA, "bloque_id").orderBy("y", "x", "id")
    medio = F.lag(F.col("y") + F.floor(F.col("h") / 2)).over(w)
    c = c.withColumn("_n", F.coalesce((F.abs(F.col("y") - medio) > SALTO).cast("int"), F.lit(0)))
    return c.withColumn("linea", F.sum("_n").over(w)).drop("_n")


def tramos(c: DataFrame) -> DataFrame:
    """``(documento_id, pagina, bloque_id, linea, tramo, tipo, n, x0, y0, x1, y1)``: runs of text and formula within the lines.

    Neighbours of one kind form a run; a formula of a single component is text after all,
    and runs that have become alike are joined.  Boxes get a margin of five pixels, not
    beyond 0.
    """
    clave = [*PAGINA, "bloque_id", "linea"]
    w = Window.partitionBy(*clave).orderBy("x", "y", "id")
    c = c.withColumn("_n", F.coalesce((F.lag("es_formula").over(w) != F.col("es_formula")).cast("int"), F.lit(1))).withColumn("_k", F.sum("_n").over(w))
    g = c.groupBy(*clave, "_k").agg(F.first("es_formula").alias("f"), F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    g = g.withColumn("f", F.col("f") & (F.col("n") >= MIN_COMPONENTES))
    v = Window.partitionBy(*clave).orderBy("_k")
    g = g.withColumn("_n", F.coalesce((F.lag("f").over(v) != F.col("f")).cast("int"), F.lit(0))).withColumn("tramo", F.sum("_n").over(v))
    cero = lambda x: F.greatest(F.lit(0), x - MARGEN)
    return g.groupBy(*clave, "tramo").agg(
        F.when(F.first("f"), "formula_inline").otherwise("texto").alias("tipo"), F.sum("n").alias("n"), cero(F.min("x0")).alias("x0"), cero(F.min("y0")).alias("y0"), (F.max("x1") + MARGEN).alias("x1"), (F.max("y1") + MARGEN).alias("y1")
    )


def rejilla(contornos: DataFrame, tamanos: DataFrame) -> DataFrame:
    """``(documento_id, pagina, bloque_id, filas, columnas, pos, x0, y0, x1, y1)``: a uniform grid of cells from the strokes of a table.

    A third of the different left edges (of boxes wider than 10) are columns, of the upper
    edges (higher than 10) rows, two at least; ``tamanos(bloque_id, ancho, alto)`` in pixels.
    """
    tercio = lambda c, si: F.greatest(F.lit(2), F.floor(F.count_distinct(F.when(si, F.col(c))) / 3)).cast("int")
    g = contornos.groupBy(*PAGINA, "bloque_id").agg(tercio("x", F.col("w") > 10).alias("columnas"), tercio("y", F.col("h") > 10).alias("filas")).join(tamanos, "bloque_id")
    cw, ch = F.floor(F.col("ancho") / F.col("columnas")), F.floor(F.col("alto") / F.col("filas"))
    g = g.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("filas") * F.col("columnas") - 1)))
    fila, col = F.floor(F.col("pos") / F.col("columnas")), F.col("pos") % F.col("columnas")
    return g.select(*PAGINA, "bloque_id", "filas", "columnas", "pos", (col * cw).alias("x0"), (fila * ch).alias("y0"), ((col + 1) * cw).alias("x1"), ((fila + 1) * ch).alias("y1"))


def recorte(bbox: Column, ancho: Column, alto: Column) -> Column:
    """Pixel box of a block inside its page image, null if it is empty."""
    c = F.struct(*[desnormalizar(bbox[k], t).alias(k) for k, t in (("x0", ancho), ("y0", alto), ("x1", ancho), ("y1", alto))])
    return F.when((c["x0"] < c["x1"]) & (c["y0"] < c["y1"]), c)


def es_nativa(textos: Column) -> Column:
    """Does the page's text layer hold anything but white space?  ``textos``: the page's texts."""
    return F.coalesce(F.exists(textos, lambda t: recortar(t) != ""), F.lit(False))
