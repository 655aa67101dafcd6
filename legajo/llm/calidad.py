"""Per-document text statistics and their distance from the prose of the language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.comun import TABLA_VISUAL, clave_tipo, fijar
from legajo.llm.idioma import FUNCIONALES, IDIOMAS

# --- fixed values: block types whose texts are mostly prose ----------------------------------
PROSA = ("parrafo", "teorema", "lema", "proposicion", "definicion", "corolario", "demostracion", "nota_pie")
# --- end of fixed values -----------------------------------------------------------------------
ESTADISTICAS = ("log_palabras", "largo_palabra", "simbolos", "digitos", "fin_linea", "comunes", "lineas_lista", "lineas_tabla", "sin_vocal", "repetidas")
K = len(ESTADISTICAS)
CORTE_D2 = 23.2  # 99 % point of a chi-square distribution with ten degrees of freedom
CORTE_C = 6.63  # the same with one: what one statistic contributes to the distance by more than chance
_ESPACIOS = "".join(chr(c) for c, v in TABLA_VISUAL.items() if c < 0x10000 and v == " ")
_NADA = "".join(chr(c) for c, v in TABLA_VISUAL.items() if c < 0x10000 and v is None)

_MARCADA = r"^\s*(?:[-•*▪‣◦]|\(?(?:\d{1,3}|\p{L}|[ivxlIVXL]{1,6})[.)])\s+\S"
_INDICE = r"\.\s?\.\s?\.\s?\.\s*\d+\s*$|^[^.,;|&]*\p{L}[^.,;|&]*(?:,\s*\d{1,4})+\s*$"
_CELDA = r"[\p{L}\d.,'’%() _-]*"
_TABLA = rf"(?U)^(?=.*\d)\s*\|?{_CELDA}(?:\s*(?:\||&|\t|;|\s{{2,}})\s*{_CELDA})+\s*(?:\||\\\\)?\s*$"


def _es_fila(x):
    """Row of a table; the cheap tests come first."""
    return (x.contains("|") | x.contains("&") | x.contains("\t") | x.contains(";") | x.contains("  ")) & x.rlike(_TABLA)


def _es_entrada(x):
    """Entry of a list (marked) or of an index (ends with page numbers)."""
    return x.rlike(_MARCADA) | (F.substring(F.rtrim(x), -1, 1).between("0", "9") & x.rlike(_INDICE))


def _esta_en(palabras: list[str]):
    return lambda w: w.isin(palabras)


def estadisticas_de_bloques(bloques: DataFrame) -> DataFrame:
    """``(documento_id, bloque_id, tipo, n, n_lista, n_tabla, idioma, z array<double>)``, one row per distinct block with text.

    All expressions run in the JVM.  ``z`` holds the statistics of ``ESTADISTICAS`` in order;
    ``idioma`` is the language with the largest share of common words.  Null, empty and
    blank texts give no row; a block delivered twice gives one.  Only the figures are
    shuffled, never the texts.
    """
    b = bloques.where("id is not null and documento_id is not null and trim(texto_plano) <> ''").select(
        "documento_id", F.col("id").alias("bloque_id"), clave_tipo(F.col("tipo")).alias("tipo"), F.length("texto_plano").alias("n"),
        # spaces of any kind are spaces, what cannot be seen is nothing
        F.when(F.col("texto_plano").rlike(r"^[\x00-\x7f]*$"), F.col("texto_plano")).otherwise(F.translate("texto_plano", _ESPACIOS + _NADA, " " * len(_ESPACIOS))).alias("t"),
    ).where("trim(t) <> ''")
    b = b.withColumn("palabras", F.filter(F.split(F.lower("t"), r"[^\p{L}\p{M}]+"), lambda w: F.length(w) > 0)).withColumn("lineas", F.filter(F.split("t", r"\n"), lambda x: F.trim(x) != ""))
    suma_largo = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x))
    b = b.select(
        "documento_id", "bloque_id", "tipo", "t",
        "n", F.greatest(F.size("palabras"), F.lit(1)).alias("np"), F.greatest(F.size("lineas"), F.lit(1)).alias("nl"),
        suma_largo("palabras").alias("letras"), F.size(F.array_distinct("palabras")).alias("nd"),
        F.size(F.filter("palabras", lambda w: (F.length(w) > 1) & (F.translate(w, "aeiouyàáâãäåèéêëìíîïòóôõöùúûüœæ", "") == w))).alias("sv"),
        *[F.size(F.filter("palabras", _esta_en(v.split()))).alias(f"c_{k}") for k, v in FUNCIONALES.items()],
        suma_largo(F.filter("lineas", _es_fila)).alias("n_tabla"),
        suma_largo(F.filter("lineas", lambda x: _es_entrada(x) & ~_es_fila(x))).alias("n_lista"),
        suma_largo("lineas").alias("n_lineas"),
        F.size(F.filter("lineas", lambda x: x.rlike(r"[.!?:;…»”\")\]∎]\s*$"))).alias("fin"),
        F.regexp_count("t", F.lit(r"\d")).alias("dig"), F.regexp_count("t", F.lit(r"[^\p{L}\p{M}\p{N}\s]")).alias("sim"),
    )
    comunes = F.greatest(*[F.col(f"c_{k}") for k in IDIOMAS])
    idioma = F.coalesce(*[F.when(F.col(f"c_{k}") == comunes, F.lit(k)) for k in IDIOMAS])
    d = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    z = F.array(
        F.log1p(d("np")), F.least(d("letras") / d("np"), F.lit(25.0)), d("sim") / d("n"), d("dig") / d("n"), d("fin") / d("nl"), d(comunes) / d("np"),
        d("n_lista") / F.greatest(d("n_lineas"), F.lit(1.0)), d("n_tabla") / F.greatest(d("n_lineas"), F.lit(1.0)), d("sv") / d("np"), 1 - d("nd") / d("np"),
    )
    return b.select("documento_id", "bloque_id", "tipo", "n", "n_lista", "n_tabla", idioma.alias("idioma"), z.alias("z")).dropDuplicates(["bloque_id"])


def _matriz(lote: pa.RecordBatch, columna: int) -> np.ndarray:
    return np.asarray(lote.column(columna).flatten(), np.float64).reshape(-1, K)


def _separar(z: np.ndarray, idiomas: np.ndarray, centro: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Contribution of each statistic to the squared distance, row by row."""
    c = np.empty_like(z)
    for k, (m, p) in centro.items():
        f = idiomas == k
        v = z[f] - m
        c[f] = v * (v @ p)
    return c


def _momentos(e: DataFrame, centro: dict | None = None) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance by language of the rows within the 99 % point of ``centro`` (all without one).

    Each batch gives its partial sums as one matrix product; the sums of five languages
    reach the driver.
    """

    def tarea(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suma = {k: np.zeros(1 + K + K * K) for k in IDIOMAS}
        for lote in lotes:
            z, idi = _matriz(lote, 1), np.array(lote.column(0).to_pylist(), object)
            dentro = np.ones(len(z), bool) if centro is None else _separar(z, idi, centro).sum(1) < CORTE_D2
            for k in IDIOMAS:
                x = z[dentro & (idi == k)]
                suma[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_pydict({"idioma": list(suma), "s": [v.tolist() for v in suma.values()]})

    partes = e.select("idioma", "z").mapInArrow(tarea, "idioma string, s array<double>")
    filas = partes.select("idioma", F.posexplode("s").alias("i", "v")).groupBy("idioma", "i").agg(F.sum("v").alias("v")).collect()
    salida = {}
    for k in IDIOMAS:
        v = np.zeros(1 + K + K * K)
        for r in filas:
            if r.idioma == k:
                v[r.i] = r.v
        if v[0]:
            m = v[1 : K + 1] / v[0]
            salida[k] = (v[0], m, v[K + 1 :].reshape(K, K) / v[0] - np.outer(m, m))
    return salida


def _distancia(e: DataFrame, centro: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Adds ``contribuciones`` (array, sums to d2) and ``d2`` under the centre of the row's language."""
    nombres = e.columns
    i, j = nombres.index("idioma"), nombres.index("z")

    def tarea(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lote in lotes:
            c = _separar(_matriz(lote, j), np.array(lote.column(i).to_pylist(), object), centro)
            cc = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * K), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([*lote.columns, cc, pa.array(c.sum(1))], names=[*nombres, "contribuciones", "d2"])

    tipos = T.StructType([*e.schema.fields, T.StructField("contribuciones", T.ArrayType(T.DoubleType())), T.StructField("d2", T.DoubleType())])
    return e.mapInArrow(tarea, tipos)


# the spread below which a difference in a statistic means nothing
_PISO = np.array([0.3, 0.4, 0.02, 0.02, 0.15, 0.05, 0.05, 0.05, 0.03, 0.06])


def _centro(mom, conjunto) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    salida = {}
    for k in IDIOMAS:
        n, m, q = mom.get(k, (0, None, None))
        if n < 50:
            n, m, q = conjunto
        salida[k] = (m, np.linalg.inv(q + np.diag(_PISO**2)))
    return salida


def _juntar(mom):
    n = sum(x[0] for x in mom.values())
    if not n:
        return 0, np.zeros(K), np.eye(K)
    m = sum(x[0] * x[1] for x in mom.values()) / n
    q = sum(x[0] * (x[2] + np.outer(x[1] - m, x[1] - m)) for x in mom.values()) / n
    return n, m, q


def distancias(bloques: DataFrame, pasos: int = 3) -> DataFrame:
    """Block statistics with robust Mahalanobis distance ``d2`` and each statistic's contribution.

    Mean and covariance per language start from blocks of prose types of at least 80
    characters and are refined by concentration: only rows within the 99 % point of the
    last estimate enter the next one, whatever their type.  A language with fewer than 50
    such blocks takes the estimate of all.
    """
    e = fijar(estadisticas_de_bloques(bloques))
    base = e.where("n >= 80")
    mom = _momentos(base.where(F.col("tipo").isin(*PROSA) & (F.col("z")[5] > 0.15)))
    for _ in range(pasos - 1):
        mom = _momentos(base, _centro(mom, _juntar(mom))) or mom
    return _distancia(e, _centro(mom, _juntar(mom)))


def clases_de_bloques(bloques: DataFrame) -> DataFrame:
    """Distances with ``lista``, ``tabla``, ``basura``: characters of the block that are of this class.

    Only blocks beyond the 99 % point of their language's prose have any, and what put
    them there decides which.  If the share of list lines (or of table rows) contributes
    more than chance, its lines are entries (or rows).  If lines contribute nothing, an
    outlier of at least 30 characters is without meaning if the word statistics (vowelless,
    repeated and overlong words, symbols, lack of common words) make up half of its
    distance or more, and not the brevity of the text; or, from 100 characters on, if it
    has no words and symbols, digits and the lack of words make up half.  Code and formulas
    have symbols and vowelless names of their own, so there these alone do not tell.
    """
    d = distancias(bloques)
    c = lambda *ns: sum((F.col("contribuciones")[ESTADISTICAS.index(n)] for n in ns), F.lit(0.0))
    fuera, largo = F.col("d2") > CORTE_D2, F.col("n") >= 100
    lista, tabla = fuera & (c("lineas_lista") > CORTE_C), fuera & (c("lineas_tabla") > CORTE_C)
    palabras = c("sin_vocal", "repetidas", "largo_palabra", "simbolos", "comunes")
    sin_palabras = F.col("z")[0] <= float(np.log1p(1)) + 1e-9
    tecnico = F.col("tipo").isin("codigo", "formula_display", "formula_inline") & (c("sin_vocal", "repetidas") < 0.5 * F.col("d2")) & ~sin_palabras
    basura = (
        fuera & ~lista & ~tabla & (F.col("n") >= 30) & ~tecnico
        & ((palabras > 0.5 * F.col("d2")) & ((c("log_palabras") < CORTE_C) | largo) | largo & sin_palabras & (c("log_palabras", "simbolos", "digitos") > 0.5 * F.col("d2")))
    )
    parte = lambda si, n: F.when(si, F.col(n)).otherwise(0)
    return d.select("*", parte(basura, "n").alias("basura"), parte(tabla, "n_tabla").alias("tabla"), parte(lista, "n_lista").alias("lista"))


def documentos_no_prosa(bloques: DataFrame) -> DataFrame:
    """``(documento_id, clase)``: more than half of the document's characters are of the class."""
    g = clases_de_bloques(bloques).groupBy("documento_id").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("lista", "tabla", "basura")])
    return g.select("documento_id", F.expr("case when 2 * lista > n then 'lista' when 2 * tabla > n then 'tabla' when 2 * basura > n then 'basura' end").alias("clase")).where("clase is not null")


def informe_documentos(documentos: DataFrame, bloques: DataFrame) -> DataFrame:
    """One row per document: statistics weighted by characters, distance, contributions, shares by class, beside ``tipos``.

    A document without text has 0 blocks and null figures.  The number of types is bounded
    by the enumeration, the lists by the ten statistics.
    """
    d = clases_de_bloques(bloques)
    n = F.sum("n")
    g = d.groupBy("documento_id").agg(
        F.count("*").alias("bloques"), n.alias("caracteres"), (F.sum(F.col("n") * F.col("d2")) / n).alias("d2_medio"),
        *[(F.sum(F.col("n") * F.col("z")[i]) / n).alias(s) for i, s in enumerate(ESTADISTICAS)],
        *[(F.sum(F.col("n") * F.col("contribuciones")[i]) / n).alias(f"c_{s}") for i, s in enumerate(ESTADISTICAS)],
        *[(F.sum(c) / n).alias(f"parte_{c}") for c in ("lista", "tabla", "basura")],
        F.array_sort(F.collect_set("tipo")).alias("tipos"),
    )
    return documentos.where("id is not null").select(F.col("id").alias("documento_id")).distinct().join(g, "documento_id", "left").withColumn("bloques", F.coalesce("bloques", F.lit(0)))
