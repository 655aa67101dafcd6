"""Stateful streams: rate limit, progress, silent jobs, running recommendations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# --- fixed values: window seconds and attempts per action ----------------------------------------
LIMITES = {"acceso": (900, 10), "procesar": (3600, 60)}
POR_DEFECTO = (3600, 100)
# --- end of fixed values -------------------------------------------------------------------------
SALIDA = "accion string, ip string, ts double, admitido boolean"


def _admitir(tiempos: list[float], vivos: list[float], ventana: int, maximo: int) -> tuple[list[bool], list[float]]:
    """Sliding log: an attempt is admitted while fewer than ``maximo`` admitted ones lie within the window; refused ones are not logged."""
    salida = []
    for t in tiempos:
        vivos = [v for v in vivos if t - v < ventana]
        ok = len(vivos) < maximo
        if ok:
            vivos.append(t)
        salida.append(ok)
    return salida, vivos


def limitar_lote(accesos: DataFrame) -> DataFrame:
    """Batch twin of the stream: ``accesos(accion, ip, ts seconds)`` → each attempt with its verdict."""

    def grupo(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        ok, _ = _admitir(pdf.ts.tolist(), [], *LIMITES.get(pdf.accion.iloc[0], POR_DEFECTO))
        return pdf.assign(admitido=ok)[["accion", "ip", "ts", "admitido"]]

    return accesos.select("accion", "ip", "ts").groupBy("accion", "ip").applyInPandas(grupo, SALIDA)


def limitar(accesos: DataFrame, retraso: str = "1 minute") -> DataFrame:
    """Rate limit per action and address over a stream; the state is the log of admitted times, at most the limit's number,
    and goes once the watermark (``retraso`` behind the latest attempt) is a window past it."""

    def grupo(clave: tuple, lotes: Iterator[pd.DataFrame], estado: GroupState) -> Iterator[pd.DataFrame]:
        if estado.hasTimedOut:  # nothing within the window any more
            estado.remove()
            return
        vivos = list(estado.get[0]) if estado.exists else []
        pdf = pd.concat(list(lotes)).sort_values("ts", kind="stable")
        ok, vivos = _admitir(pdf.ts.tolist(), vivos, *LIMITES.get(clave[0], POR_DEFECTO))
        estado.update((vivos,))
        # kept until the watermark is a window past the last attempt
        estado.setTimeoutTimestamp(max(int(1000 * (pdf.ts.max() + LIMITES.get(clave[0], POR_DEFECTO)[0])), estado.getCurrentWatermarkMs() + 1))
        yield pdf.assign(admitido=ok)[["accion", "ip", "ts", "admitido"]]

    e = accesos.select("accion", "ip", "ts", F.timestamp_seconds("ts").alias("hora")).withWatermark("hora", retraso)
    return e.groupBy("accion", "ip").applyInPandasWithState(grupo, SALIDA, "vivos array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def progreso(eventos: DataFrame) -> DataFrame:
    """Last state per document and layer of ``eventos(documento_id, capa, estado, ts)``; for update or complete mode."""
    return eventos.groupBy("documento_id", "capa").agg(F.max(F.struct("ts", "estado")).alias("x")).select("documento_id", "capa", F.col("x.estado").alias("estado"), F.col("x.ts").alias("ts"))


def silenciosos(latidos: DataFrame, silencio: str = "10 minutes", retraso: str = "10 minutes") -> DataFrame:
    """Sessions of heartbeats that ended in silence: ``(documento_id, desde, hasta, latidos)`` once the watermark passes."""
    s = latidos.withWatermark("ts", retraso).groupBy("documento_id", F.session_window("ts", silencio)).agg(F.count("*").alias("latidos"))
    return s.select("documento_id", F.col("session_window.start").alias("desde"), F.col("session_window.end").alias("hasta"), "latidos")


def espaciado(eventos: DataFrame, pasos: int = 100) -> DataFrame:
    """Progress events ``(documento_id, n, total)`` worth telling: every hundredth of the total, and the last."""
    cada = F.greatest(F.lit(1), F.floor(F.col("total") / pasos))
    return eventos.where((F.col("n") % cada == 0) | (F.col("n") == F.col("total")))


def recomendaciones_vivas(decisiones: DataFrame, umbrales: DataFrame) -> DataFrame:
    """Threshold proposals over the append-only log of decisions as it grows; for complete mode, ``umbrales`` is a static table."""
    from legajo.operators.revision import proponer

    return proponer(decisiones, umbrales)


def drenar(df: DataFrame, spark: SparkSession, nombre: str, modo: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and give back the collected table (for small results and tests)."""
    w = df.writeStream.format("memory").queryName(nombre).outputMode(modo).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return spark.table(nombre)
