"""Review: queues, keyset pages, decisions and what follows from them."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.texto import ngramas, primero_no_vacio, recortar, tipo_normal
from legajo.operators.orden import numerar
from legajo.sources.tablas import unicos

NO_TRADUCIBLES = ("formula_display", "formula_inline", "codigo", "figura", "ruido", "tabla")


def filtrar_documentos(documentos: DataFrame, estado: str | None = None, buscar: str | None = None, necesita_revision: bool | None = None) -> DataFrame:
    """Documents by state, title (ILIKE, wildcards count) and review flag; an empty filter filters nothing."""
    d = unicos(documentos, "titulo", "estado", "creado_en", "total_paginas", "total_bloques", "necesita_revision")
    if estado:
        d = d.where(F.col("estado") == estado)
    if buscar and buscar.strip():
        d = d.where(F.col("titulo").ilike(f"%{buscar.strip()}%"))
    if necesita_revision is not None:
        d = d.where(F.col("necesita_revision") == necesita_revision)
    return d


def cifrar_cursor(micros: int, clave: str) -> str:
    return base64.urlsafe_b64encode(f"{micros}|{clave}".encode()).decode()


def descifrar_cursor(cursor: str) -> tuple[int, str]:
    """Raises ValueError on anything that is no cursor."""
    try:
        m, clave = base64.urlsafe_b64decode(cursor.encode()).decode().split("|", 1)
        return int(m), clave
    except Exception as e:
        raise ValueError("invalid cursor") from e


def pagina_de_documentos(documentos: DataFrame, limite: int = 20, cursor: str | None = None, **filtro) -> DataFrame:
    """Newest first by (created, id), one row beyond ``limite`` (1 to 200) to show whether more follow.

    A keyset predicate, so it reaches the scan, and a top-k, never a full sort.
    """
    d = filtrar_documentos(documentos, **filtro).withColumn("micros", F.unix_micros("creado_en"))
    if cursor:
        m, clave = descifrar_cursor(cursor)
        d = d.where((F.col("micros") < m) | ((F.col("micros") == m) & (F.col("id") < clave)))
    return d.orderBy(F.desc_nulls_last("micros"), F.desc("id")).limit(max(1, min(limite, 200)) + 1)


def en_orden(bloques: DataFrame) -> DataFrame:
    """``(documento_id, bloque_id, puesto)``: reading order of a document's blocks."""
    b = unicos(bloques, "documento_id", "pagina", "orden_lectura").withColumnRenamed("id", "bloque_id")
    return numerar(b, "documento_id", F.col("pagina"), ["orden_lectura", "bloque_id"], "puesto").select("documento_id", "bloque_id", "puesto")


def cola_de_revision(bloques: DataFrame) -> DataFrame:
    """Pending blocks with their place in the document's queue: lowest confidence first, null last, then reading order."""
    b = unicos(bloques, "documento_id", "pagina", "orden_lectura", "confianza_global", "estado_revision").where("estado_revision = 'pendiente'")
    # thousandths of confidence cut the queue of a large document into pieces; no number, then none, come last
    c = F.col("confianza_global")
    paso = F.when(c.isNull(), 5000).when(F.isnan(c), 4000).otherwise(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(3.0), c)) * 1000))
    n = numerar(b, "documento_id", paso, [F.asc_nulls_last("confianza_global"), "pagina", "orden_lectura", "id"], "puesto")
    return n.select("documento_id", F.col("id").alias("bloque_id"), "confianza_global", "puesto")


def siguiente_pendiente(bloques: DataFrame) -> DataFrame:
    """The head of each document's queue; a minimum that combines map-side instead of a window."""
    b = unicos(bloques, "documento_id", "pagina", "orden_lectura", "confianza_global", "estado_revision").where("estado_revision = 'pendiente'")
    k = F.struct(F.col("confianza_global").isNull().alias("n"), F.col("confianza_global").alias("c"), "pagina", "orden_lectura", F.col("id"))
    return b.groupBy("documento_id").agg(F.min(k)["id"].alias("bloque_id"))


def poca_confianza(bloques: DataFrame, layout: float = 0.7, engine: float = 0.6) -> DataFrame:
    """Blocks with a low layout confidence or any low micro-segment."""
    b = unicos(bloques, "documento_id", "confianza_layout", "micro_segmentos")
    return b.where((F.col("confianza_layout") < layout) | F.coalesce(F.exists("micro_segmentos", lambda s: s["confianza_engine"] < engine), F.lit(False))).select("documento_id", F.col("id").alias("bloque_id"))


def micro_segmentos_bajos(bloques: DataFrame, corte: float = 0.6) -> DataFrame:
    """``(documento_id, pagina, bloque_id, idx, tipo, contenido, confianza)`` of micro-segments below the cut."""
    b = unicos(bloques, "documento_id", "pagina", "micro_segmentos").select("documento_id", "pagina", F.col("id").alias("bloque_id"), F.posexplode("micro_segmentos").alias("idx", "s"))
    return b.where(F.col("s.confianza_estructural") < corte).select("documento_id", "pagina", "bloque_id", "idx", F.col("s.tipo").alias("tipo"), F.col("s.contenido").alias("contenido"), F.col("s.confianza_estructural").alias("confianza"))


def estado_derivado(escalacion_humana: Column, confianza: Column, corte: float = 0.7) -> Column:
    return F.when(F.coalesce(escalacion_humana, F.lit(False)) | F.coalesce(confianza < corte, F.lit(False)), "pendiente").otherwise("no_requiere")


def traducibles(bloques: DataFrame) -> DataFrame:
    """Blocks to translate: prose types with text, ``texto`` from the final or the plain content."""
    b = unicos(bloques, "documento_id", "pagina", "orden_lectura", "tipo", "contenido_final", "texto_plano").withColumn("tipo", tipo_normal(F.col("tipo"))).where(~F.col("tipo").isin(*NO_TRADUCIBLES))
    b = b.withColumn("texto", primero_no_vacio(F.col("contenido_final"), F.col("texto_plano"))).where(recortar(F.col("texto")) != "")
    return b.select("documento_id", "pagina", F.col("orden_lectura").alias("orden"), F.col("id").alias("bloque_id"), "tipo", "texto")


def en_lotes(t: DataFrame, tamano: int = 12) -> DataFrame:
    """Adds ``lote``: the batch of ``tamano`` blocks in reading order."""
    n = numerar(t, "documento_id", F.col("pagina"), ["orden", "bloque_id"], "puesto")
    return n.withColumn("lote", F.floor((F.col("puesto") - 1) / tamano)).drop("puesto")


def lotes(t: DataFrame, tamano: int = 12) -> DataFrame:
    """``(documento_id, lote, n, caracteres)`` of the batches."""
    # only lengths are shuffled, not the texts
    return en_lotes(t.withColumn("texto", F.length("texto")), tamano).groupBy("documento_id", "lote").agg(F.count("*").alias("n"), F.sum("texto").alias("caracteres"))


# --- fixed values: words that are no terms -----------------------------------------------------
VACIAS = (
    "the of and to in a is that for as we be by with are this it on or an from can which such all if then let we have has been not there each any one two both "
    "el la los las de del que en un una es por con para se su sus como al lo más si no ya sea son este esta estos estas cuando donde entonces sobre entre"
).split()
TERMINO = r"[A-Za-zÁÉÍÓÚÑáéíóúñ][A-Za-zÁÉÍÓÚÑáéíóúñ-]{2,29}"
# --- end of fixed values -----------------------------------------------------------------------


def terminos(bloques: DataFrame, minimo: int = 3, cuantos: int = 40) -> DataFrame:
    """``(documento_id, termino, apariciones)``: the ``cuantos`` most frequent terms of each document in their first surface form, ties by alphabet.

    Counted per document and term before the window, which Spark limits to the group's head.
    """
    p = traducibles(bloques).select("documento_id", "pagina", "orden", "bloque_id", F.posexplode(F.regexp_extract_all("texto", F.lit(rf"(?U)\b({TERMINO})\b"), F.lit(1))).alias("i", "forma"))
    primera = F.min(F.struct("pagina", "orden", "bloque_id", "i", "forma"))["forma"]
    g = p.groupBy("documento_id", F.lower("forma").alias("clave")).agg(F.count("*").alias("apariciones"), primera.alias("termino")).where(~F.col("clave").isin(*VACIAS) & (F.col("apariciones") >= minimo))
    w = Window.partitionBy("documento_id").orderBy(F.desc("apariciones"), "clave")
    return g.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cuantos).select("documento_id", "termino", "apariciones")


def gasto_acumulado(costos: DataFrame, tope: float) -> DataFrame:
    """Calls of a document in time order with the cost spent before; ``dentro`` while that is below the cap (0: none)."""
    c = unicos(costos, "documento_id", "costo_usd", "registrado_en").where("documento_id is not null")
    w = Window.partitionBy("documento_id").orderBy("registrado_en", "id").rowsBetween(Window.unboundedPreceding, -1)
    previo = F.coalesce(F.sum("costo_usd").over(w), F.lit(0.0))
    return c.select("documento_id", F.col("id").alias("costo_id"), (F.lit(tope <= 0) | (previo < tope)).alias("dentro"))


def recomendaciones(decisiones: DataFrame, umbrales: DataFrame) -> DataFrame:
    """Proposed thresholds per block type from the rates of its decisions, with the confidence of the proposal."""
    return proponer(unicos(decisiones, "tipo_bloque", "decision", "confianza_engine", "confianza_usuario"), umbrales)


def proponer(d: DataFrame, umbrales: DataFrame) -> DataFrame:
    """The proposals from distinct decisions, a batch or a stream (complete mode)."""
    d = d.where("tipo_bloque <> ''")
    g = d.groupBy("tipo_bloque").agg(F.avg((F.col("decision") == "rechazar").cast("int")).alias("rechazo"), F.avg("confianza_engine").alias("ce"), F.avg("confianza_usuario").alias("cu"))
    u = umbrales.where("ambito = 'global'").select(F.col("clave").alias("tipo_bloque"), F.col("valor").alias("actual"))
    g = g.join(F.broadcast(u), "tipo_bloque", "left").withColumn("actual", F.coalesce("actual", F.lit(0.7)))  # one row per type
    sube, baja = F.col("rechazo") > 0.3, F.col("cu") > F.col("ce") + 0.2
    g = g.where(sube | baja).select(
        "tipo_bloque", "actual", F.when(sube, F.least(F.lit(0.95), F.col("actual") + 0.1)).otherwise(F.greatest(F.lit(0.5), F.col("actual") - 0.05)).alias("nuevo"),
        F.when(sube, F.greatest(F.lit(0.5), 1 - F.col("rechazo"))).otherwise(0.75).alias("confianza"),
    )
    return g.withColumn("aplicable", (F.col("confianza") > 0.7) & (F.abs(F.col("nuevo") - F.col("actual")) > 0.02))


def actualizar(viejo: DataFrame, nuevo: DataFrame, clave: str = "clave", valor: str = "valor") -> DataFrame:
    """``(clave, antes, valor)``: a map with some entries replaced or added."""
    j = viejo.select(clave, F.col(valor).alias("antes")).join(nuevo.select(clave, F.col(valor).alias("nuevo")), clave, "full")
    return j.select(clave, "antes", F.coalesce("nuevo", "antes").alias(valor))


def aplicar_recomendaciones(decisiones: DataFrame, umbrales: DataFrame, claves: list[str] | None = None, solo_aplicables: bool = True) -> DataFrame:
    """``(clave, antes, despues)`` of every threshold once the proposals are applied: the applicable ones, of the asked types or all."""
    r = recomendaciones(decisiones, umbrales)
    if solo_aplicables:
        r = r.where("aplicable")
    if claves:
        r = r.where(F.col("tipo_bloque").isin(*claves))
    u = umbrales.where("ambito = 'global'").select("clave", "valor")
    return actualizar(u, r.select(F.col("tipo_bloque").alias("clave"), F.col("nuevo").alias("valor"))).withColumnRenamed("valor", "despues")


def contenido_vigente(bloques: DataFrame, decisiones: DataFrame) -> DataFrame:
    """``(bloque_id, decision, contenido)``: the latest decision that settles a block, by time, then id."""
    d = unicos(decisiones, "bloque_id", "decision", "contenido_final", "registrado_en").where("bloque_id is not null and decision in ('aceptar', 'rechazar', 'editar')")
    u = d.groupBy("bloque_id").agg(F.max(F.struct("registrado_en", "id", "decision", "contenido_final")).alias("x"))
    b = unicos(bloques, "contenido_final", "texto_plano").withColumnRenamed("id", "bloque_id")
    return b.join(u, "bloque_id").select("bloque_id", F.col("x.decision").alias("decision"), F.when(F.col("x.decision") == "editar", F.coalesce("x.contenido_final", F.lit(""))).otherwise(primero_no_vacio(F.col("contenido_final"), F.col("texto_plano"))).alias("contenido"))


def bleu(pares: DataFrame, n_max: int = 4) -> DataFrame:
    """``(bleu, pares)`` of the whole corpus ``pares(id, candidato, referencia)``: clipped n-gram counts, brevity penalty.

    The n-grams of both sides leave the row as hashes and are counted per pair and n in one
    shuffle, then summed; one row comes out.
    """
    palabras = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    p = pares.select("id", palabras(F.col("candidato")).alias("c"), palabras(F.col("referencia")).alias("r"))
    largo = p.agg(F.sum(F.size("c")).alias("lc"), F.sum(F.size("r")).alias("lr"), F.count("*").alias("pares"))
    uno = lambda lado, n, c, r: F.transform(ngramas(F.col(lado), n), lambda x: F.struct(F.lit(n).alias("n"), F.xxhash64(x).alias("h"), F.lit(c).alias("c"), F.lit(r).alias("r")))
    g = p.select("id", F.explode(F.concat(*[uno(lado, n, int(lado == "c"), int(lado == "r")) for n in range(1, n_max + 1) for lado in "cr"])).alias("x"))
    j = g.groupBy("id", "x.n", "x.h").agg(F.sum("x.c").alias("n_c"), F.sum("x.r").alias("n_r"))
    s = j.groupBy("n").agg(F.sum("n_c").alias("total"), F.sum(F.least("n_c", "n_r")).alias("igual"))
    f = s.agg(F.count_if(F.col("igual") > 0).alias("ordenes"), F.sum(F.when(F.col("igual") > 0, F.log(F.col("igual") / F.col("total")))).alias("suma"))
    bp = F.when(F.col("lc") > F.col("lr"), 1.0).otherwise(F.exp(1 - F.col("lr") / F.nullif(F.col("lc"), F.lit(0))))
    return f.crossJoin(largo).select(F.coalesce(F.when(F.col("ordenes") == n_max, bp * F.exp(F.col("suma") / n_max)), F.lit(0.0)).alias("bleu"), "pares")  # one row each
