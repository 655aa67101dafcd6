"""Values that look the same but are stored with different characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.comun import fijar, forma_unica, visual

CAMPOS = ("texto_plano", "latex")
PARTE = 5_000
SALES = 8  # parts of a class whatever its size, for joins on the class


@F.pandas_udf(T.StructType([T.StructField("forma", T.StringType()), T.StructField("vista", T.StringType())]))
def _formas(lotes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in lotes:
        de = {v: (forma_unica(v), visual(v)) for v in s.dropna().unique()}
        pares = [de.get(v, (None, None)) for v in s]
        yield pd.DataFrame(pares, columns=["forma", "vista"])


def valores(bloques: DataFrame, campos: tuple[str, ...] = CAMPOS) -> DataFrame:
    """``(bloque_id, campo, valor)``: every non-null value; the empty text is a value like any other."""
    pares = ", ".join(f"'{c}', `{c}`" for c in campos)
    return bloques.where("id is not null").select(F.col("id").alias("bloque_id"), F.expr(f"stack({len(campos)}, {pares}) as (campo, valor)")).where("valor is not null")


def formas(bloques: DataFrame, campos: tuple[str, ...] = CAMPOS) -> DataFrame:
    """``(bloque_id, campo, valor, forma, vista)``.

    ``forma`` is the consistent form for comparisons: compatibility normalisation,
    composed, full case folding, white space mapped, default-ignorable characters removed,
    look-alike letters mapped.  ``vista`` keeps what can be seen (case, accents, raised
    signs, line breaks, number of spaces).  Equal ``vista`` implies equal ``forma``.
    Each distinct value of a batch is normalised once.  No shuffle.
    """
    v = valores(bloques, campos)
    return v.withColumn("f", _formas("valor")).select("bloque_id", "campo", "valor", "f.forma", "f.vista")


def clases(bloques: DataFrame, campos: tuple[str, ...] = CAMPOS) -> DataFrame:
    """``(bloque_id, campo, forma, clase)``, one row per block, field and value; ``clase`` names the visual class."""
    return formas(bloques, campos).select("bloque_id", "campo", "forma", F.md5(F.concat_ws("|", "campo", "vista")).alias("clase")).distinct()


def _miembros(bloques: DataFrame, campos: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``(miembros(bloque_id, campo, kv, kr, sal), cuentas(campo, kv, kr, n))`` of the classes with several spellings.

    ``kv`` is a hash (128 bits) of the comparison form together with what is seen, ``kr`` one
    of the value, so texts are never shuffled; the hashes are checkpointed, the texts read
    once.  Classes with one spelling only, however many copies, drop out in a map-side
    combined aggregation.  The joins are on class and salt, so that the copies of a text
    that stands in a large part of all blocks spread over ``SALES`` tasks.
    """
    f = fijar(
        formas(bloques, campos).select(
            "bloque_id", "campo", F.unhex(F.md5(F.concat_ws("\u0000", "forma", "vista"))).alias("kv"), F.unhex(F.md5("valor")).alias("kr"), F.pmod(F.xxhash64("bloque_id"), F.lit(SALES)).cast("int").alias("sal")
        )
    )
    varias = f.groupBy("campo", "kv").agg(F.min("kr").alias("a"), F.max("kr").alias("b")).where("a <> b").select("campo", "kv", F.explode(F.sequence(F.lit(0), F.lit(SALES - 1))).alias("sal"))
    m = fijar(f.join(varias, ["campo", "kv", "sal"], "left_semi").distinct())
    return m, m.groupBy("campo", "kv", "kr").agg(F.count("*").alias("n"))


def enlaces(bloques: DataFrame, campos: tuple[str, ...] = CAMPOS) -> DataFrame:
    """``(bloque_id, campo, clase, enlaces)``: blocks of classes with several spellings, with the number of blocks spelled otherwise.

    One row per block, field and spelling, whatever the size of the class: the way to use
    the classes where their pairs are too many.
    """
    m, v = _miembros(bloques, campos)
    total = v.groupBy("campo", "kv").agg(F.sum("n").alias("total"))
    c = v.join(total, ["campo", "kv"]).withColumn("sal", F.explode(F.sequence(F.lit(0), F.lit(SALES - 1))))
    return m.join(c, ["campo", "kv", "kr", "sal"]).select("bloque_id", "campo", F.lower(F.hex("kv")).alias("clase"), (F.col("total") - F.col("n")).alias("enlaces"))


def pares_iguales_a_la_vista(bloques: DataFrame, campos: tuple[str, ...] = CAMPOS) -> DataFrame:
    """``(bloque_a, bloque_b, campo)``, ``bloque_a < bloque_b``: values that look the same but differ in characters.

    Classes (see ``_miembros``) are joined spelling by spelling: two copies of one spelling
    are never paired, and the larger side of a pair of spellings is cut into parts of
    ``PARTE`` blocks, so that no task holds more than one part times one spelling.  A block
    delivered with two spellings of one value is not paired with itself.
    """
    m, v = _miembros(bloques, campos)
    va, vb = v.select("campo", "kv", F.col("kr").alias("ka"), F.col("n").alias("na")), v.select("campo", "kv", F.col("kr").alias("kb"), F.col("n").alias("nb"))
    pv = va.join(vb, ["campo", "kv"]).where("na > nb or na = nb and ka < kb")
    pv = pv.withColumn("partes", F.expr(f"cast(ceil(na / {PARTE}) as int)"))
    # the larger side in parts: its members carry a part number, the pair is repeated for each part
    p = v.select("campo", "kv", "kr", F.expr(f"cast(ceil(n / {PARTE}) as int)").alias("partes"), F.explode(F.sequence(F.lit(0), F.lit(SALES - 1))).alias("sal"))
    grandes = m.join(p, ["campo", "kv", "kr", "sal"])
    grandes = grandes.select("campo", "kv", F.col("kr").alias("ka"), F.col("bloque_id").alias("ia"), F.expr("cast(pmod(xxhash64(bloque_id), partes) as int)").alias("parte"))
    chicos = m.select("campo", "kv", "sal", F.col("kr").alias("kb"), F.col("bloque_id").alias("ib"))
    pb = pv.withColumn("parte", F.explode(F.expr("sequence(0, partes - 1)"))).select("campo", "kv", "ka", "kb", "parte", F.explode(F.sequence(F.lit(0), F.lit(SALES - 1))).alias("sal"))
    pb = pb.join(chicos, ["campo", "kv", "kb", "sal"]).drop("sal")
    return (
        pb.join(grandes, ["campo", "kv", "ka", "parte"])
        .where("ia <> ib")
        .select(F.least("ia", "ib").alias("bloque_a"), F.greatest("ia", "ib").alias("bloque_b"), "campo")
        .distinct()
    )
