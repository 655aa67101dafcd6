"""Numbering rows of groups that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numerar(df: DataFrame, grupo: str, cubo: Column, orden: list, nombre: str) -> DataFrame:
    """Adds ``nombre``: the row's place from 1 within ``grupo`` in the order (``cubo``, ``orden``).

    ``cubo`` is a first sort key (a page, a step of a score) that cuts a group into pieces.
    Rows are numbered within (group, bucket), and the sizes of the buckets before are added
    as prefix sums, so no task sorts a whole group: only its bucket counts.  Null groups and
    buckets count as values; null buckets come first.
    """
    g, c = F.coalesce(F.col(grupo).cast("string"), F.lit("\u0000")), F.struct(cubo.isNotNull().alias("hay"), cubo.alias("v"))
    x = df.withColumn("_g", F.xxhash64(g)).withColumn("_c", c)
    n = x.groupBy("_g", "_c").agg(F.count("*").alias("_n"))
    antes = n.withColumn("_antes", F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    antes = antes.select("_g", F.col("_c.hay").alias("_h"), F.col("_c.v").alias("_v"), "_antes")
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "_c").orderBy(*orden)))
    j = x.join(antes, (x._g == antes._g) & (x["_c.hay"] == antes._h) & x["_c.v"].eqNullSafe(antes._v))
    return j.select(*[x[k] for k in df.columns], (F.col("_k") + F.col("_antes")).cast("int").alias(nombre))
