"""Statistics of decisions, costs, documents and blocks; one pass each, combined map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.sources.tablas import unicos

# --- fixed values: thresholds of the layers, and what counts as a problem -------------------------
UMBRALES_CAPA = {"capa3_micro_segmento": 0.60, "capa3_parrafo": 0.75, "capa3_formula": 0.65, "capa3_tabla": 0.70}
PROBLEMAS = ("rechazar", "escalar", "editar")
# --- end of fixed values --------------------------------------------------------------------------
_si = lambda c: F.avg(c.cast("int").cast("double"))


def de_decisiones(decisiones: DataFrame) -> DataFrame:
    """``(decision, tipo_bloque, n, confianza, cambio)`` by decision, by type and in all; ``cambio``: percentage whose text was changed."""
    d = unicos(decisiones, "decision", "tipo_bloque", "confianza_usuario", "contenido_original", "contenido_final")
    d = d.select("decision", "tipo_bloque", "confianza_usuario", (~F.col("contenido_original").eqNullSafe(F.col("contenido_final"))).alias("otro"))
    return d.groupingSets([["decision"], ["tipo_bloque"], []], "decision", "tipo_bloque").agg(F.count("*").alias("n"), F.avg("confianza_usuario").alias("confianza"), (100 * _si(F.col("otro"))).alias("cambio"))


def patrones(decisiones: DataFrame, clases: tuple[str, ...] = ("rechazar", "escalar"), cuantos: int = 5) -> DataFrame:
    """``(decision, tipo_bloque, n, puesto)``: the block types with most decisions of each class, ties by alphabet."""
    d = unicos(decisiones, "decision", "tipo_bloque").where(F.col("decision").isin(*clases)).groupBy("decision", "tipo_bloque").agg(F.count("*").alias("n"))
    w = Window.partitionBy("decision").orderBy(F.desc("n"), F.asc_nulls_last("tipo_bloque"))
    return d.withColumn("puesto", F.row_number().over(w)).where(F.col("puesto") <= cuantos)


def poco_confiables(decisiones: DataFrame, corte: float = 0.7) -> DataFrame:
    """``(tipo_bloque, confianza)`` of the types with a mean engine confidence below ``corte``, lowest first."""
    g = unicos(decisiones, "tipo_bloque", "confianza_engine").groupBy("tipo_bloque").agg(F.avg("confianza_engine").alias("confianza"))
    return g.where(F.col("confianza") < corte).orderBy("confianza", "tipo_bloque")


def acierto_del_modelo(decisiones: DataFrame) -> DataFrame:
    """``(n, acierto)``: share of accepted among accepted and rejected with a model confidence (null and 0 are none); 0 without any."""
    d = unicos(decisiones, "decision", "confianza_llm").where("confianza_llm <> 0")
    si, no = F.count_if(F.col("decision") == "aceptar"), F.count_if(F.col("decision") == "rechazar")
    return d.agg(F.count("*").alias("n"), F.coalesce(si / F.nullif(si + no, F.lit(0)), F.lit(0.0)).alias("acierto"))


def problematicos(decisiones: DataFrame, cuantos: int = 5) -> DataFrame:
    """``(tipo_bloque, tasa)``: the types with the largest share of rejected, escalated or edited blocks, ties by alphabet."""
    g = unicos(decisiones, "tipo_bloque", "decision").groupBy("tipo_bloque").agg(_si(F.coalesce(F.col("decision").isin(*PROBLEMAS), F.lit(False))).alias("tasa"))
    return g.orderBy(F.desc("tasa"), F.asc_nulls_last("tipo_bloque")).limit(cuantos)


def potencial(decisiones: DataFrame, cambio: int = 50) -> DataFrame:
    """``(menores, total, potencial)``: edits that change the length by less than ``cambio``, as a percentage of all decisions, at most 100; 0 without decisions."""
    d = unicos(decisiones, "decision", "contenido_original", "contenido_final")
    menor = (F.col("decision") == "editar") & (F.abs(F.length("contenido_final") - F.length("contenido_original")) < cambio)
    d = d.select(menor.alias("m")).agg(F.count_if("m").alias("menores"), F.count("*").alias("total"))
    return d.withColumn("potencial", F.least(F.lit(100.0), F.coalesce(100 * F.col("menores") / F.nullif("total", F.lit(0)), F.lit(0.0))))


def retroalimentacion(decisiones: DataFrame) -> DataFrame:
    """``(tipo_bloque, capa, actual, recomendado, regla)``: proposals of the feedback loop per type.

    Layer 3: more than three tenths rejected raise the threshold, users surer than the
    engine by a fifth lower it.  Layer 4: more than a fifth escalated.  Types without a
    threshold of their own have 0.7.  A missing confidence counts as 0, as in a sum.
    """
    d = unicos(decisiones, "tipo_bloque", "decision", "confianza_engine", "confianza_usuario").where("tipo_bloque is not null")
    g = d.groupBy("tipo_bloque").agg(
        _si(F.coalesce(F.col("decision") == "rechazar", F.lit(False))).alias("r"), _si(F.coalesce(F.col("decision") == "escalar", F.lit(False))).alias("e"),
        F.avg(F.coalesce("confianza_engine", F.lit(0.0))).alias("ce"), F.avg(F.coalesce("confianza_usuario", F.lit(0.0))).alias("cu"),
    )
    clave = F.concat(F.lit("capa3_"), F.lower("tipo_bloque"))
    actual = F.coalesce(*[F.when(clave == k, F.lit(v)) for k, v in UMBRALES_CAPA.items()], F.lit(0.70))
    sube, baja = F.col("r") > 0.3, F.col("cu") > F.col("ce") + 0.20
    capa3 = F.when(sube, F.struct(F.lit(3).alias("capa"), actual.alias("actual"), F.least(F.lit(0.95), actual + 0.10).alias("recomendado"), F.lit("rechazo").alias("regla"))).when(
        baja, F.struct(F.lit(3).alias("capa"), actual.alias("actual"), F.greatest(F.lit(0.50), actual - 0.05).alias("recomendado"), F.lit("confianza").alias("regla"))
    )
    capa4 = F.when(F.col("e") > 0.2, F.struct(F.lit(4).alias("capa"), F.lit(0.80).alias("actual"), F.lit(0.70).alias("recomendado"), F.lit("escalacion").alias("regla")))
    return g.select("tipo_bloque", F.explode(F.array_compact(F.array(capa3, capa4))).alias("x")).select("tipo_bloque", "x.*")


def metricas(documentos: DataFrame, bloques: DataFrame, decisiones: DataFrame) -> DataFrame:
    """One row: documents, their blocks as stored, decisions, percentage of changed texts, mean confidence of blocks."""
    d = unicos(documentos, "total_bloques").agg(F.count("*").alias("documentos"), F.coalesce(F.sum("total_bloques"), F.lit(0)).alias("bloques"))
    c = unicos(decisiones, "contenido_original", "contenido_final").select((~F.col("contenido_original").eqNullSafe(F.col("contenido_final"))).alias("otro"))
    s = c.agg(F.count("*").alias("decisiones"), F.coalesce(100 * _si(F.col("otro")), F.lit(0.0)).alias("cambio"))
    b = unicos(bloques, "confianza_global").agg(F.avg("confianza_global").alias("confianza"))
    return d.crossJoin(s).crossJoin(b)  # one row each


def costo_por_documento(documentos: DataFrame, costos: DataFrame) -> DataFrame:
    """``(id, costo)`` of every document, 0 without calls."""
    c = unicos(costos, "documento_id", "costo_usd").groupBy(F.col("documento_id").alias("id")).agg(F.sum("costo_usd").alias("costo"))
    return unicos(documentos).join(c, "id", "left").select("id", F.coalesce("costo", F.lit(0.0)).alias("costo"))


def totales(documentos: DataFrame) -> DataFrame:
    """``(estado, n, paginas)`` per state."""
    return unicos(documentos, "estado", "total_paginas").groupBy("estado").agg(F.count("*").alias("n"), F.sum("total_paginas").alias("paginas"))


def salud(documentos: DataFrame) -> DataFrame:
    """``(documentos)``: the number of stored documents, the figure of a health check."""
    return unicos(documentos).agg(F.count("*").alias("documentos"))


def por_pagina(bloques: DataFrame) -> DataFrame:
    return unicos(bloques, "documento_id", "pagina").groupBy("documento_id", "pagina").agg(F.count("*").alias("n"))


def diferencias(pares: DataFrame) -> DataFrame:
    """``(n, distintas, porcentaje)`` of ``pares(a, b)``: outputs of two versions that differ; pairs with a null do not count."""
    d = pares.where("a is not null and b is not null").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("distintas"))
    return d.withColumn("porcentaje", F.coalesce(100 * F.col("distintas") / F.nullif("n", F.lit(0)), F.lit(0.0)))


def de_cola(segmentos: DataFrame) -> DataFrame:
    """``(documento_id, paginas, segmentos)`` waiting in the queue of micro-segments."""
    return segmentos.groupBy("documento_id").agg(F.count_distinct("pagina").alias("paginas"), F.count("*").alias("segmentos"))
