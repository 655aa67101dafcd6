"""The query surface: filters, lookups and pages over documents, blocks and decisions.

Every filter is optional and stands on projected columns, so it reaches the scan; repeated
deliveries are collapsed after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.sources.tablas import unicos

LIGERAS = ("documento_id", "pagina", "orden_lectura", "tipo", "confianza_global", "estado_revision")
PESADAS = ("texto_plano", "latex", "contenido_final", "micro_segmentos", "escalacion", "bbox")
# --- fixed values: resolution and modes of the engine --------------------------------------------
DPI_MINIMO, DPI_MAXIMO = 72, 600
MODOS = ("hibrido", "solo_ia")
# --- end of fixed values -------------------------------------------------------------------------


def bloques_filtrados(bloques: DataFrame, pagina: int | None = None, tipos: list[str] | None = None, estado: str | None = None, confianza_max: float | None = None, incluir: tuple[str, ...] = ()) -> DataFrame:
    """Blocks by page, types, review state and highest confidence (a null confidence drops out); heavy columns only if asked for."""
    malas = set(incluir) - set(PESADAS)
    if malas:
        raise ValueError(f"unknown columns: {sorted(malas)}")
    b = unicos(bloques, *LIGERAS, *incluir)
    if pagina is not None:
        b = b.where(F.col("pagina") == pagina)
    if tipos:
        b = b.where(F.col("tipo").isin(*tipos))
    if estado:
        b = b.where(F.col("estado_revision") == estado)
    if confianza_max is not None:
        b = b.where(F.col("confianza_global") <= confianza_max)
    return b


def bloque(bloques: DataFrame, documento_id: str, bloque_id: str) -> DataFrame:
    """One block of one document; no row if the block belongs to another."""
    return unicos(bloques, *LIGERAS, "texto_plano").where((F.col("documento_id") == documento_id) & (F.col("id") == bloque_id))


def poca_confianza_panel(bloques: DataFrame, corte: float = 0.7) -> DataFrame:
    """Blocks whose overall or layout confidence is below the cut; a null confidence is not."""
    b = unicos(bloques, "documento_id", "confianza_global", "confianza_layout").where((F.col("confianza_global") < corte) | (F.col("confianza_layout") < corte))
    return b.select("documento_id", F.col("id").alias("bloque_id"))


def decisiones_filtradas(decisiones: DataFrame, documento_id: str = "", tipo: str = "", decision: str = "") -> DataFrame:
    """Decisions by document, block type and decision; the empty text filters nothing."""
    d = unicos(decisiones, "documento_id", "bloque_id", "tipo_bloque", "decision")
    for c, v in (("documento_id", documento_id), ("tipo_bloque", tipo), ("decision", decision)):
        if v:
            d = d.where(F.col(c) == v)
    return d


def vencidos(documentos: DataFrame, ahora: datetime, dias: int) -> DataFrame:
    """``(id, ruta_pdf)`` of stored files older than ``dias``; none for 0 days or less, files without a date are kept."""
    d = unicos(documentos, "ruta_pdf", "creado_en").where("ruta_pdf is not null")
    hasta = F.lit(ahora) - F.make_interval(days=F.lit(dias))
    return (d.where(F.col("creado_en") <= hasta) if dias > 0 else d.where("false")).select("id", "ruta_pdf")


def colgados(documentos: DataFrame, ahora: datetime, minutos: int = 10) -> DataFrame:
    """``(id, estado)`` of jobs under way without a sign of life for ``minutos``; one that never gave any counts."""
    d = unicos(documentos, "estado", "latido_en", "creado_en").where("estado in ('procesando', 'en_cola')")
    vida = F.coalesce("latido_en", "creado_en")
    return d.where(vida.isNull() | (vida <= F.lit(ahora) - F.make_interval(mins=F.lit(minutos)))).select("id", "estado")


def bloques_por_pagina(documentos: DataFrame, bloques: DataFrame) -> DataFrame:
    """``(documento_id, pagina, n)`` for every page of every document, 0 for a page without blocks."""
    p = unicos(documentos, "total_paginas").where("total_paginas > 0").select(F.col("id").alias("documento_id"), F.explode(F.sequence(F.lit(0), F.col("total_paginas") - 1)).alias("pagina"))
    c = unicos(bloques, "documento_id", "pagina").groupBy("documento_id", "pagina").agg(F.count("*").alias("n"))
    return p.join(c, ["documento_id", "pagina"], "left").select("documento_id", "pagina", F.coalesce("n", F.lit(0)).alias("n"))


def pagina_de_bloques(bloques: DataFrame, documento_id: str, limite: int = 50, cursor: tuple[int, int] | None = None, por_confianza: bool = False) -> DataFrame:
    """Blocks of a document in reading order after a (page, place) cursor, one beyond ``limite`` (1 to 200); by confidence there is no cursor."""
    b = unicos(bloques, "documento_id", "pagina", "orden_lectura", "confianza_global").where(F.col("documento_id") == documento_id)
    if por_confianza and cursor:
        raise ValueError("no cursor in order of confidence")
    if cursor:
        b = b.where((F.col("pagina") > cursor[0]) | ((F.col("pagina") == cursor[0]) & (F.col("orden_lectura") > cursor[1])))
    claves = [F.asc_nulls_last("confianza_global")] if por_confianza else []
    return b.orderBy(*claves, "pagina", "orden_lectura", "id").limit(max(1, min(limite, 200)) + 1)


def requiere_reconocimiento(origen: Column, segmentos: Column, modo: Column) -> Column:
    """Does a block go to recognition?  All in AI mode; else scanned ones, and native ones that hold a formula."""
    formula = F.coalesce(F.exists(segmentos, lambda s: s["tipo"] == "formula_inline"), F.lit(False))
    return (modo == "solo_ia") | ~origen.eqNullSafe(F.lit("texto_nativo")) | formula


def modo_valido(modo: Column) -> Column:
    """The engine mode; null and blank are the hybrid one, any other unknown text is null."""
    m = F.lower(F.trim(modo))
    return F.when(F.coalesce(m, F.lit("")) == "", MODOS[0]).when(m.isin(*MODOS), m)


def dpi_valido(dpi: Column) -> Column:
    """``(dpi int, valido boolean)``: null for "auto" and blank, whole numbers from 72 to 600; all else is invalid."""
    t = F.trim(F.coalesce(dpi, F.lit("")))
    n = F.when(t.rlike(r"^[+-]?\d{1,9}$"), t.try_cast("int"))
    libre = (t == "") | (F.lower(t) == "auto")
    ok = libre | F.coalesce(n.between(DPI_MINIMO, DPI_MAXIMO), F.lit(False))
    return F.struct(F.when(ok & ~libre, n).alias("dpi"), ok.alias("valido"))


def fuera_de_escala(umbrales: DataFrame) -> DataFrame:
    """Thresholds outside 0 to 1, null or not a number."""
    return umbrales.where("not coalesce(valor between 0 and 1 and not isnan(valor), false)").select("ambito", "clave", "valor")
