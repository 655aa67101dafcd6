"""Table sources and sinks.

Rows of the project's tables are delivered at least once, each delivery of an id the same;
``unicos`` collapses repeated deliveries after projection, so only the columns a query
needs are read and shuffled, and filters reach the scan.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLAS = ("documentos", "bloques", "ocr_resultados", "decisiones", "costos", "umbrales")

ESQUEMA_DECISIONES = (
    "id bigint, documento_id string, bloque_id string, pagina int, tipo_bloque string, decision string, contenido_original string, contenido_final string, "
    "confianza_engine double, confianza_llm double, confianza_usuario double, comentarios string, revisor string, registrado_en timestamp"
)


def tabla(spark: SparkSession, sf_dir: str, nombre: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{nombre}.parquet")


def unicos(df: DataFrame, *columnas: str) -> DataFrame:
    """Project, then drop repeated deliveries.

    All projected columns are grouping keys, so a filter on any of them is pushed below
    the shuffle.  Deliveries that differ in a projected column stay apart.
    """
    return df.select("id", *[c for c in columnas if c != "id"]).distinct()


def con_carpeta(df: DataFrame) -> DataFrame:
    """Make sure that the session has a checkpoint folder: its own or ``spark.checkpoint.dir``.

    Where neither is set, a local session (tests) gets a temporary folder; on a cluster that
    would be one machine's disk, so it is an error there.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        carpeta = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not carpeta and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(carpeta or tempfile.mkdtemp(prefix="legajo-"))
    return df


def fijar(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint (see ``con_carpeta``)."""
    return con_carpeta(df).checkpoint(eager=True)


def agregar_jsonl(df: DataFrame, ruta: str) -> None:
    """Append records as JSON lines, null fields kept."""
    df.write.mode("append").option("ignoreNullFields", "false").json(ruta)


def leer_jsonl(spark: SparkSession, ruta: str, esquema: str = ESQUEMA_DECISIONES) -> DataFrame:
    """Read JSON lines with a fixed schema; lines that are no record give nulls, never a failure."""
    return spark.read.schema(esquema).json(ruta)


def exportar_csv(df: DataFrame, ruta: str) -> None:
    """CSV with a header; embedded quotes and line breaks survive a round trip."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(ruta)


def fusionar_manifiesto(previo: DataFrame, nuevo: DataFrame, clave: str = "pdf") -> DataFrame:
    """Earlier rows whose key was not processed again, and the new rows."""
    return previo.join(nuevo.select(clave).distinct(), clave, "left_anti").unionByName(nuevo, allowMissingColumns=True)


def reemplazar_documentos(actual: DataFrame, nuevo: DataFrame, clave: str = "documento_id") -> DataFrame:
    """Bulk replacement of whole documents: delete by key, insert the new rows."""
    return fusionar_manifiesto(actual, nuevo, clave)


def borrar_en_cascada(hijo: DataFrame, borrados: DataFrame, clave: str = "documento_id") -> DataFrame:
    """Rows of a child table that survive the deletion of ``borrados(id)``; rows without a parent key stay."""
    return hijo.join(borrados.select(F.col("id").alias(clave)).distinct(), clave, "left_anti")


# --- fixed values: limits of uploads -------------------------------------------------------------
MAX_BYTES, MAX_PAGINAS = 50 * 1024 * 1024, 1000
# --- end of fixed values -------------------------------------------------------------------------


def archivos(spark: SparkSession, carpeta: str) -> DataFrame:
    """Files of a folder with their contents, newest first (``path, modificationTime, length, content``)."""
    return spark.read.format("binaryFile").load(carpeta).orderBy(F.desc("modificationTime"), "path")


def fallo_de_archivo(largo: Column, inicio: Column, paginas: Column) -> Column:
    """The first thing wrong with an upload, null if nothing is: empty, too large, no document, no pages, too many.

    ``inicio``: its first characters, white space in front of the signature is allowed.
    """
    return (
        F.when(F.coalesce(largo, F.lit(0)) == 0, "vacio").when(largo > MAX_BYTES, "muy_grande").when(~F.coalesce(F.regexp_replace(inicio, r"^\s+", "").startswith("%PDF-"), F.lit(False)), "no_es_pdf")
        .when(F.coalesce(paginas, F.lit(0)) < 1, "sin_paginas").when(paginas > MAX_PAGINAS, "demasiadas_paginas")
    )


def extraer_paginas(paginas: DataFrame, elegidas: DataFrame) -> DataFrame:
    """``paginas(documento_id, pagina, …)`` of ``elegidas(documento_id, pagina)``, numbered anew from 0, with ``pagina_origen``; a document without a choice keeps all."""
    con = elegidas.select("documento_id").distinct()
    todas = paginas.join(con, "documento_id", "left_anti").withColumn("pagina_origen", F.col("pagina"))
    k = elegidas.select("documento_id", "pagina").distinct()
    # numbered among the chosen pages of the table, before its columns come along
    n = paginas.select("documento_id", "pagina").distinct().join(k, ["documento_id", "pagina"], "left_semi")
    n = n.withColumn("_n", F.row_number().over(Window.partitionBy("documento_id").orderBy("pagina")) - 1)
    algunas = paginas.join(n, ["documento_id", "pagina"]).withColumn("pagina_origen", F.col("pagina")).withColumn("pagina", F.col("_n").cast(paginas.schema["pagina"].dataType)).drop("_n")
    return todas.select(*paginas.columns, "pagina_origen").unionByName(algunas.select(*paginas.columns, "pagina_origen"))


def agregar(df: DataFrame, ruta: str) -> None:
    """Append rows to a stored table (the ledger of costs, the log of decisions)."""
    df.write.mode("append").parquet(ruta)


def guardar_umbrales(umbrales: DataFrame, ruta: str) -> None:
    """``umbrales(ambito, clave, valor)`` as one JSON object per scope; a table of settings, so one file."""
    g = umbrales.groupBy("ambito").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("clave", "valor")))).alias("valores"))
    g.coalesce(1).write.mode("overwrite").json(ruta)


def leer_umbrales(spark: SparkSession, ruta: str, por_defecto: DataFrame | None = None) -> DataFrame:
    """Back to ``(ambito, clave, valor)``; entries missing in the file come from ``por_defecto``."""
    u = spark.read.schema("ambito string, valores map<string,double>").json(ruta).select("ambito", F.explode("valores").alias("clave", "valor"))
    return u if por_defecto is None else u.unionByName(por_defecto.join(u, ["ambito", "clave"], "left_anti").select(*u.columns))


def migrar(df: DataFrame, nuevas: dict[str, object] | None = None, fuera: tuple[str, ...] = (), unica: bool = False) -> DataFrame:
    """Schema migration: missing columns come with a default, old ones go, a table of settings keeps its first row by id.  Doing it again changes nothing."""
    for c, v in (nuevas or {}).items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v))
    df = df.drop(*[c for c in fuera if c in df.columns])
    return df.orderBy("id").limit(1) if unica else df
