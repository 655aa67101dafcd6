"""Score cutoffs that keep a target fraction of each source's records, exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.comun import clave_tipo, fijar

CENTILES = 200


def cortes(registros: DataFrame, objetivos: DataFrame, max_orden: int = 200_000) -> DataFrame:
    """Cutoffs of ``registros(fuente, puntaje)`` for ``objetivos(fuente, fraccion)``.

    Result: ``(fuente, fraccion, corte, n_total, n_conservados)``; the cutoff is the highest
    score for which the records at or above it are at least ``fraccion`` of the source.

    Sketch-bracketed exact selection.  A mergeable quantile sketch (rank error at most
    1/20000 of its rows, guaranteed) gives per source 201 quantiles; two of them, one step
    beyond the target on either side, bracket it.  Records above the bracket are counted,
    and only bracketed records are grouped by score and sorted.  While a bracket holds more
    than ``max_orden`` records it is sketched again, so no task ever sorts more than that,
    but for a bracket whose scores are all equal, which needs no sort.  The driver sees one
    row per source of ``objetivos`` (a small table of settings), never records.

    Null, NaN and sourceless records do not count (the caller gives the scale); a source without
    records or with a null fraction has no row; fraction 0 gives the highest score and
    fraction above 1 none.  Ties are kept together.  ``registros`` is read several times.
    """
    spark = registros.sparkSession
    reg = registros.select("fuente", "puntaje").where("fuente is not null and puntaje is not null and not isnan(puntaje)")
    metas = {r.fuente: r.fraccion for r in objetivos.where("fuente is not null and fraccion is not null").groupBy("fuente").agg(F.max("fraccion").alias("fraccion")).collect()}
    esquema = "fuente string, bajo double, alto double, encima bigint, total bigint, meta double"
    estado: dict[str, list] = {}
    rejilla = [i / CENTILES for i in range(CENTILES + 1)]
    activos: dict[str, tuple] = {f: (float("-inf"), float("inf")) for f in metas}
    while activos:
        filas = [(f, b, a, 0, 0, 0.0) for f, (b, a) in activos.items()]
        cerca = F.broadcast(spark.createDataFrame(filas, esquema).select("fuente", "bajo", "alto"))
        # one pass: counts above the bracket, inside it, and the sketch of what is inside
        dentro = F.when((F.col("puntaje") >= F.col("bajo")) & (F.col("puntaje") <= F.col("alto")), F.col("puntaje"))
        resumen = (
            reg.join(cerca, "fuente")
            .groupBy("fuente")
            .agg(
                F.count("*").alias("total"),
                F.count_if(F.col("puntaje") > F.col("alto")).alias("encima"),
                F.count(dentro).alias("dentro"),
                F.percentile_approx(dentro, rejilla, 20_000).alias("q"),
            )
            .collect()
        )
        vistos = {r.fuente: r for r in resumen}
        nuevos = {}
        for f, (bajo, alto) in activos.items():
            r = vistos.get(f)
            if r is None:
                continue
            falta = metas[f] * r.total - r.encima  # records still needed from inside the bracket
            estado[f] = [bajo, alto, r.encima, r.total]
            if r.dentro <= max_orden or r.q is None or r.q[0] == r.q[-1]:
                continue
            p = (1 - falta / r.dentro) * CENTILES
            i, j = max(0, min(CENTILES, int(p) - 1)), max(0, min(CENTILES, int(p) + 2))
            nb, na = (bajo if i == 0 else r.q[i]), (alto if j == CENTILES else r.q[j])
            if (nb, na) != (bajo, alto):
                nuevos[f] = (nb, na)
        activos = nuevos
    filas = [(f, b, a, int(e), int(t), float(metas[f])) for f, (b, a, e, t) in estado.items()]
    cerca = F.broadcast(spark.createDataFrame(filas, esquema))
    # grouped by score first: ties collapse before the window, which is bounded by max_orden
    por_puntaje = (
        reg.join(cerca, "fuente").where("puntaje >= bajo and puntaje <= alto").groupBy("fuente", "puntaje", "encima", "total", "meta").count()
    )
    w = Window.partitionBy("fuente").orderBy(F.desc("puntaje")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        por_puntaje.withColumn("n", F.sum("count").over(w) + F.col("encima"))
        .where("n >= meta * total")
        .groupBy("fuente")
        .agg(F.first("meta").alias("fraccion"), F.max("puntaje").alias("corte"), F.first("total").alias("n_total"), F.max_by("n", "puntaje").alias("n_conservados"))
    )


def registros_por_tipo(ocr: DataFrame, bloques: DataFrame, umbrales: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(registros(bloque_id, fuente, puntaje), objetivos(fuente, fraccion))`` of the project's tables.

    A record is a distinct result id with a confidence in [0, 1] whose block has the type;
    types are compared without case, accents and outer white space.  Repeated deliveries
    collapse, results without a block and blocks without a type drop out.
    """
    objetivos = umbrales.where("ambito = 'objetivo_corte'").select(clave_tipo(F.col("clave")).alias("fuente"), F.col("valor").alias("fraccion"))
    o = ocr.where("confianza_global between 0 and 1 and not isnan(confianza_global)").select(F.col("id").alias("bloque_id"), F.col("confianza_global").alias("puntaje"))
    b = bloques.select(F.col("id").alias("bloque_id"), clave_tipo(F.col("tipo")).alias("fuente")).join(F.broadcast(objetivos.select("fuente").distinct()), "fuente", "left_semi")
    reg = o.join(b, "bloque_id").groupBy("bloque_id", "fuente").agg(F.max("puntaje").alias("puntaje"))
    return reg, objetivos


def conservados(ocr: DataFrame, bloques: DataFrame, umbrales: DataFrame) -> DataFrame:
    """``(bloque_id)`` of the records at or above the cutoff of their type, each once."""
    reg, objetivos = registros_por_tipo(ocr, bloques, umbrales)
    reg = fijar(reg)
    c = cortes(reg, objetivos).select("fuente", "corte")
    # one row per configured type
    return reg.join(F.broadcast(c), "fuente").where("puntaje >= corte").select("bloque_id").distinct()


def informe_cortes(ocr: DataFrame, bloques: DataFrame, umbrales: DataFrame) -> DataFrame:
    """``(tipo, fraccion, corte, n_total, n_conservados)``."""
    reg, objetivos = registros_por_tipo(ocr, bloques, umbrales)
    return cortes(fijar(reg), objetivos).withColumnRenamed("fuente", "tipo")


_BASE = """
 obj as (select trim(lower(strip_accents(clave))) fuente, max(valor) fraccion from umbrales where ambito='objetivo_corte' and valor is not null group by 1),
 o as (select id bloque_id, max(confianza_global) puntaje from ocr_resultados where confianza_global between 0 and 1 and not isnan(confianza_global) group by 1),
 b as (select distinct id bloque_id, lower(strip_accents(regexp_replace(tipo,'^[\\s\\p{Z}]+|[\\s\\p{Z}]+$','','g'))) fuente from bloques),
 r as (select o.bloque_id, fuente, fraccion, puntaje from o join b using (bloque_id) join obj using (fuente)),
 s as (select *, count(*) over (partition by fuente order by puntaje desc range between unbounded preceding and current row) n, count(*) over (partition by fuente) total from r),
 c as (select fuente, any_value(fraccion) fraccion, max(puntaje) corte, any_value(total) n_total from s where n >= fraccion*total group by 1)
"""

SQL = {
    "p2_found": f"with {_BASE} select distinct bloque_id from r join (select fuente, corte from c) using (fuente) where puntaje >= corte",
    "p2_cortes": f"with {_BASE} select c.fuente tipo, c.fraccion, corte, n_total, count(*) n_conservados from c join r on r.fuente=c.fuente and puntaje>=corte group by 1,2,3,4",
}
