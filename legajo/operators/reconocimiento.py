"""Recognition and correction of blocks: routing, engine results, table cells, escalation with a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.confianza import estructura, micro_segmento
from legajo.functions.texto import normalizar_latex, primero_no_vacio, recortar, reparar_entornos, reparar_estructura, reparar_pares, tipo_normal
from legajo.operators.correccion import inconsistencias, sugerencias
from legajo.sources.tablas import fijar

CON_FORMULAS = ("parrafo", "teorema", "lema", "definicion", "demostracion", "nota_pie")

# --- fixed values: whole-word substitutions, in order, whatever the case ------------------------
SUSTITUCIONES = (
    ("rn", "m"), ("l", "1"), ("O", "0"), ("acá", "acá"), ("tenia", "tenía"), ("sería", "sería"), ("habia", "había"), ("podria", "podría"), ("seria", "sería"), ("recibia", "recibía"),
)
# --- end of fixed values ------------------------------------------------------------------------


def ruta(tipo: Column, origen: Column, segmentos: Column, modo: Column, transcrito: Column) -> Column:
    """Route of a block by the first rule that holds; propositions and corollaries take the simple one."""
    formula = F.coalesce(F.exists(segmentos, lambda s: s["tipo"].startswith("formula")), F.lit(False))
    nativo = origen == "texto_nativo"
    return (
        F.when(tipo.isin("ruido", "figura"), "sin_reconocer").when(modo == "solo_ia", "solo_ia").when(nativo & ~formula, "nativo").when(nativo & formula, "nativo_con_formulas")
        .when(transcrito, "ya_transcrito").when(tipo == "formula_display", "formula_display").when(tipo == "tabla", "tabla").when(tipo.isin(*CON_FORMULAS), "texto_con_formulas").otherwise("simple")
    )


def sustituir_formulas(segmentos: DataFrame, resultados: DataFrame, corte: float = 0.5) -> DataFrame:
    """``(bloque_id, texto)``: segments in order, a formula replaced by its recognised LaTeX if that is good enough.

    ``segmentos(bloque_id, idx, tipo, contenido)``, ``resultados(bloque_id, idx, latex, confianza)``.
    """
    j = segmentos.join(resultados, ["bloque_id", "idx"], "left")
    envuelta = F.when(F.col("latex").startswith("$"), F.col("latex")).otherwise(F.concat(F.lit("$"), "latex", F.lit("$")))
    pieza = F.when(F.col("tipo").startswith("formula") & (F.col("latex") != "") & (F.col("confianza") >= corte), envuelta).otherwise(F.coalesce("contenido", F.lit("")))
    return j.groupBy("bloque_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", pieza.alias("p")))), lambda x: x["p"]), " ").alias("texto"))


def recomponer_tabla(celdas: DataFrame) -> DataFrame:
    """``(bloque_id, texto)``: cells in row-major order as a Markdown table with a rule after the first row.

    ``celdas(bloque_id, filas, columnas, pos, contenido)``; positions without a cell come out empty.
    """
    grilla = celdas.groupBy("bloque_id").agg(F.max("filas").alias("f"), F.max("columnas").alias("c"), F.map_from_entries(F.collect_list(F.struct("pos", F.coalesce("contenido", F.lit("")).alias("v")))).alias("m"))
    fila = lambda i: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda k: F.coalesce(F.try_element_at("m", i * F.col("c") + k), F.lit(""))), " | "), F.lit(" |"))
    regla = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("c")), " | "), F.lit(" |"))
    filas = F.transform(F.sequence(F.lit(0), F.col("f") - 1), fila)
    return grilla.select("bloque_id", F.array_join(F.concat(F.slice(filas, 1, 1), F.array(regla), F.slice(filas, 2, F.col("f"))), "\n").alias("texto"))


def corregir(tipo: Column, texto: Column) -> Column:
    """Structure of a block's text (spelling: ``corregir_bloques``): formulas normalised, text with LaTeX repaired, code and plain text kept, blank to empty."""
    return (
        F.when(F.coalesce(recortar(texto), F.lit("")) == "", "").when(tipo == "codigo", texto).when(tipo.isin("formula_display", "formula_inline"), reparar_estructura(normalizar_latex(texto)))
        .when(texto.contains("$") | texto.contains("\\"), reparar_estructura(texto)).otherwise(texto)
    )


def sustituir_fijas(texto: Column) -> Column:
    for mal, bien in SUSTITUCIONES:
        texto = F.regexp_replace(texto, rf"(?iU)\b{mal}\b", bien)
    return texto


def corregir_bloques(bloques: DataFrame, general: DataFrame, tecnico: DataFrame) -> DataFrame:
    """``(bloque_id, texto)``: every block corrected, structure first, then spelling; code keeps its spelling.

    Spelling: the fixed substitutions, then each word outside the dictionary (``tecnico`` for
    formulas, ``general`` else; column ``palabra``) becomes its suggestion, an initial
    capital kept.  Suggestions are sought once per distinct word.
    """
    # the steps of ``corregir`` one by one: nested, each repeats the one before many times
    tipo, texto = tipo_normal(F.col("tipo")), F.col("texto")
    b = bloques.select(F.col("id").alias("bloque_id"), tipo.alias("tipo"), F.when(F.coalesce(recortar(F.col("texto_plano")), F.lit("")) == "", "").otherwise(F.col("texto_plano")).alias("texto")).distinct()
    b = b.select("bloque_id", F.when(F.col("tipo") == "codigo", "codigo").when(F.col("tipo").isin("formula_display", "formula_inline"), "tecnico").otherwise("general").alias("lista"), "texto")
    formula = F.col("lista") == "tecnico"
    b = b.withColumn("texto", F.when(formula, normalizar_latex(texto)).otherwise(texto))
    repara = (texto != "") & (formula | (F.col("lista") == "general") & (texto.contains("$") | texto.contains("\\")))
    for paso in (lambda c: reparar_pares(c, "{", "}"), lambda c: reparar_pares(c, "(", ")"), reparar_entornos):
        b = b.withColumn("texto", F.when(repara, paso(texto)).otherwise(texto))
    b = b.withColumn("texto", F.when(F.col("lista") == "codigo", texto).otherwise(sustituir_fijas(texto)))
    palabras = F.regexp_extract_all("texto", F.lit(r"(?U)\w+"), F.lit(0))
    # cut here, so that texts are corrected once and a number stands for the block where words are shuffled
    b = fijar(b.withColumn("k", F.monotonically_increasing_id()))
    w = b.where("lista <> 'codigo'").select("k", "lista", F.explode(F.array_distinct(F.transform(palabras, F.lower))).alias("palabra"))
    v = fijar(w.select("lista", "palabra").distinct())
    s = [sugerencias(v.where(F.col("lista") == n), fijar(d.select("palabra").distinct())).select(F.lit(n).alias("lista"), "palabra", "sugerencia") for n, d in (("general", general), ("tecnico", tecnico))]
    m = w.join(fijar(s[0].unionByName(s[1])), ["lista", "palabra"]).groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("palabra", "sugerencia"))).alias("mapa"))

    def pon(x: Column) -> Column:
        c = F.try_element_at("mapa", F.lower(x))
        mayuscula = F.substring(x, 1, 1).rlike(r"^\p{Lu}")
        return F.when(c.isNull(), x).when(mayuscula, F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000_000))).otherwise(c)

    trozos = F.regexp_extract_all("texto", F.lit(r"(?U)\w+|\W+"), F.lit(0))
    return b.join(m, "k", "left").select("bloque_id", F.when(F.col("mapa").isNull(), F.col("texto")).otherwise(F.array_join(F.transform(trozos, pon), "")).alias("texto"))


def corregir_documento(bloques: DataFrame, general: DataFrame, tecnico: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrected blocks, and the inconsistencies (gaps, unresolved references) of the blocks as they were read."""
    return corregir_bloques(bloques, general, tecnico), inconsistencias(bloques)


def escalar(segmentos: DataFrame, respuestas: DataFrame, tope: float) -> DataFrame:
    """Answers for low micro-segments under a spend cap per document.

    ``segmentos(documento_id, pagina, bloque_id, idx)``, ``respuestas(bloque_id, idx, contenido, confianza, costo)``.
    A page is escalated while the cost of the pages before it is below the cap (0: no cap);
    the rest, and segments without an answer, go to a person.  Costs are never negative, so
    a running sum over pages decides exactly.
    """
    j = segmentos.join(respuestas, ["bloque_id", "idx"], "left")
    p = j.groupBy("documento_id", "pagina").agg(F.sum(F.coalesce("costo", F.lit(0.0))).alias("c"))
    w = Window.partitionBy("documento_id").orderBy("pagina").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("dentro", F.lit(tope <= 0) | (F.coalesce(F.sum("c").over(w), F.lit(0.0)) < tope)).drop("c")
    r = j.join(p, ["documento_id", "pagina"])
    humano = ~F.col("dentro") | F.col("contenido").isNull()
    return r.select("documento_id", "pagina", "bloque_id", "idx", F.when(~humano, F.col("contenido")).alias("contenido"), F.when(~humano, F.col("confianza")).alias("confianza"), humano.alias("requiere_revision_humana"))


def aplicar_a_bloques(escaladas: DataFrame) -> DataFrame:
    """``(bloque_id, contenido, confianza, requiere_revision_humana)``: the last answered segment wins, any open one needs a person."""
    return escaladas.groupBy("bloque_id").agg(
        F.max_by("contenido", F.when(F.col("contenido").isNotNull(), F.col("idx"))).alias("contenido"), F.max_by("confianza", F.when(F.col("contenido").isNotNull(), F.col("idx"))).alias("confianza"),
        F.max("requiere_revision_humana").alias("requiere_revision_humana"),
    )


def calidad_de_resultados(ocr: DataFrame) -> DataFrame:
    """Structural score and usable confidence of recognition results; a confidence off the scale counts as none."""
    c = F.when(F.col("confianza_global").between(0, 1) & ~F.isnan("confianza_global"), F.col("confianza_global"))
    return ocr.select("id", estructura(F.col("contenido"), F.lit(False)).alias("estructura"), c.alias("confianza"), primero_no_vacio(F.col("contenido")).alias("contenido"))


# --- fixed values: engines, and the confidence below which a result goes to the language model --------
LATEX, TEXTO, PAGINA_ENTERA = "pix2tex", "easyocr", "doctr"
ESCALA, CELDA_LATEX, FORMULA_ACEPTADA, SIN_FORMULA, SIN_IMAGEN = 0.6, 0.7, 0.5, 0.95, 0.7
# --- end of fixed values -------------------------------------------------------------------------------


def reconocer(bloques: DataFrame, segmentos: DataFrame, celdas: DataFrame, resultados: DataFrame) -> DataFrame:
    """``(bloque_id, ruta, contenido, micro_segmentos, confianza, requiere_escalacion)``: every block by its route.

    ``bloques(bloque_id, tipo, origen, modo, transcrito, texto, confianza_layout, hay_imagen)``,
    ``segmentos(bloque_id, idx, tipo, contenido)``, ``celdas(bloque_id, filas, columnas, pos)``;
    ``resultados(bloque_id, idx, latex, conf_latex, texto, conf_texto)`` holds what the engines
    gave for a segment, a cell (``idx`` = ``pos``) or a whole block (``idx`` = -1).

    Noise and figures come out empty and sure, native text as it stands; an image that gave
    no result comes out empty and goes to the language model.  Work is one row per unit,
    joined to its result and put together per block, so a block's routes cost no pass each.
    """
    seg = segmentos.groupBy("bloque_id").agg(F.collect_set(F.struct("tipo")).alias("s"))
    b = bloques.join(seg, "bloque_id", "left").withColumn("ruta", ruta(F.col("tipo"), F.col("origen"), F.col("s"), F.col("modo"), F.col("transcrito") & (primero_no_vacio(F.col("texto")) != ""))).drop("s")
    b = fijar(b)
    entero = b.where(F.col("ruta").isin("solo_ia", "formula_display", "simple")).select("bloque_id", "ruta", "tipo", F.lit(-1).alias("idx"), F.lit(None).cast("string").alias("clase"), F.lit(None).cast("string").alias("previo"))
    partes = b.where(F.col("ruta").isin("nativo_con_formulas", "texto_con_formulas")).select("bloque_id", "ruta", "tipo").join(segmentos.select("bloque_id", "idx", F.col("tipo").alias("clase"), F.col("contenido").alias("previo")), "bloque_id")
    tabla_ = b.where("ruta = 'tabla'").select("bloque_id", "ruta", "tipo").join(celdas.select("bloque_id", F.col("pos").alias("idx")).distinct(), "bloque_id").withColumns({"clase": F.lit(None).cast("string"), "previo": F.lit(None).cast("string")})
    cols = ["bloque_id", "ruta", "tipo", "idx", "clase", "previo"]
    u = entero.select(cols).unionByName(partes.select(cols)).unionByName(tabla_.select(cols)).join(resultados, ["bloque_id", "idx"], "left")
    es = F.coalesce(F.col("clase").startswith("formula"), F.lit(False))
    formula = F.when(F.col("ruta") == "solo_ia", F.col("tipo") == "formula_display").when(F.col("ruta") == "formula_display", True).when(F.col("ruta").isin("simple", "tabla"), False).otherwise(es)
    con_latex = F.when(F.col("ruta").isin("solo_ia", "formula_display"), True).when(F.col("ruta") == "tabla", F.coalesce((F.col("conf_latex") > CELDA_LATEX) & (F.length("latex") > 3), F.lit(False))).when(F.col("ruta") == "simple", False).otherwise(es)
    u = u.withColumns({"formula": formula, "con_latex": con_latex}).withColumns({"crudo": F.when(F.col("con_latex"), F.col("latex")).otherwise(F.col("texto")), "ce": F.when(F.col("con_latex"), F.col("conf_latex")).otherwise(F.col("conf_texto"))})
    envuelto = F.when((F.col("crudo") == "") | F.col("crudo").startswith("$"), F.col("crudo")).otherwise(F.concat(F.lit("$"), "crudo", F.lit("$")))
    nativo, mixto = F.col("ruta") == "nativo_con_formulas", F.col("ruta") == "texto_con_formulas"
    hay = F.col("ce").isNotNull() & ~(nativo & ~F.col("formula"))
    # the native route judges the bare formula, the scanned one the wrapped
    u = u.withColumn("dado", F.when(mixto & F.col("formula"), envuelto).otherwise(F.col("crudo"))).withColumn("cs", F.when(hay, micro_segmento(F.col("ce"), F.col("dado"), F.col("formula"))))
    final = F.when(nativo, F.when(hay & (F.col("crudo") != "") & (F.col("cs") >= FORMULA_ACEPTADA), envuelto).otherwise(F.coalesce("previo", F.lit("")))).otherwise(F.coalesce("dado", F.lit("")))
    clase = F.when(F.col("ruta").isin("solo_ia", "formula_display"), F.when(F.col("formula"), "formula_display").otherwise("texto")).when(F.col("formula"), "formula_inline").otherwise("texto")
    micro = F.when(hay & (F.col("ruta") != "tabla"), F.struct(clase.alias("tipo"), F.col("final").alias("contenido"), F.when(F.col("con_latex"), LATEX).otherwise(TEXTO).alias("engine_usado"), F.col("ce").alias("confianza_engine"), F.col("cs").alias("confianza_estructural")))
    u = u.withColumn("final", final).withColumn("micro", micro).withColumn("c", F.when(F.col("ruta") == "tabla", F.col("ce")).otherwise(F.col("cs")))
    orden = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("idx", x.alias("x")))), lambda y: y["x"])
    g = u.groupBy("bloque_id").agg(orden(F.col("final")).alias("piezas"), F.array_compact(orden(F.col("micro"))).alias("micro"), F.avg("c").alias("media"))
    t = recomponer_tabla(celdas.join(u.where("ruta = 'tabla'").select("bloque_id", F.col("idx").alias("pos"), F.col("final").alias("contenido")), ["bloque_id", "pos"])).withColumnRenamed("texto", "tabla")
    j = b.join(g, "bloque_id", "left").join(t, "bloque_id", "left")
    r, texto = F.col("ruta"), primero_no_vacio(F.col("texto"))
    sin_imagen = (r == "nativo_con_formulas") & ~F.coalesce("hay_imagen", F.lit(True))
    contenido = (
        F.when(r == "sin_reconocer", "").when(r.isin("nativo", "ya_transcrito") | sin_imagen, texto).when(r == "tabla", F.coalesce("tabla", F.lit("")))
        .otherwise(F.array_join(F.when(r == "nativo_con_formulas", F.filter("piezas", lambda x: x != "")).otherwise(F.col("piezas")), " "))
    )
    confianza = F.when(r == "sin_reconocer", 1.0).when(r == "nativo", SIN_FORMULA).when(r == "ya_transcrito", F.col("confianza_layout")).when(sin_imagen, SIN_IMAGEN).when(r == "nativo_con_formulas", F.coalesce("media", F.lit(SIN_FORMULA))).otherwise(F.coalesce("media", F.lit(0.0)))
    transcrito = F.array(F.struct(F.lit("texto").alias("tipo"), texto.alias("contenido"), F.lit(PAGINA_ENTERA).alias("engine_usado"), F.col("confianza_layout").alias("confianza_engine"), F.col("confianza_layout").alias("confianza_estructural")))
    vacio = F.array().cast(j.schema["micro"].dataType)
    j = j.select("bloque_id", "ruta", F.coalesce(contenido, F.lit("")).alias("contenido"), F.when(r == "ya_transcrito", transcrito).when(sin_imagen, vacio).otherwise(F.coalesce("micro", vacio)).alias("micro_segmentos"), confianza.alias("confianza"))
    return j.withColumn("requiere_escalacion", F.coalesce(F.col("confianza") < ESCALA, F.lit(False)))


def cola_de_paginas(segmentos: DataFrame) -> DataFrame:
    """``(documento_id, pagina, segmentos)``: the queue by page, each page's segments in order of block and place; one page is one call."""
    return segmentos.groupBy("documento_id", "pagina").agg(F.array_sort(F.collect_list(F.struct("bloque_id", "idx"))).alias("segmentos"))


def resolver_inconsistencias(inconsistencias_: DataFrame, respuestas: DataFrame) -> DataFrame:
    """``(documento_id, clase, detalle, pagina, n, contenido, confianza, requiere_revision_humana, costo, costo_propio)``.

    One answer per document, ``respuestas(documento_id, contenido, confianza, costo,
    requiere_revision_humana)``, stands for all its inconsistencies.  ``costo`` repeats the
    cost of the call for each, as it is logged; ``costo_propio`` has it once.  Documents
    without an answer need a person.
    """
    w = Window.partitionBy("documento_id", "clase").orderBy("pagina", "detalle")
    # places within a kind; the call's cost goes to the first row of the first kind
    i = inconsistencias_.withColumn("n", F.row_number().over(w))
    primera = inconsistencias_.groupBy("documento_id").agg(F.min("clase").alias("_c"))
    j = i.join(primera, "documento_id").join(respuestas, "documento_id", "left")
    humano = F.coalesce("requiere_revision_humana", F.lit(True))
    propio = F.when((F.col("n") == 1) & (F.col("clase") == F.col("_c")), F.coalesce("costo", F.lit(0.0))).otherwise(0.0)
    return j.select("documento_id", "clase", "detalle", "pagina", "n", "contenido", "confianza", humano.alias("requiere_revision_humana"), F.coalesce("costo", F.lit(0.0)).alias("costo"), propio.alias("costo_propio"))


def para_revision(bloques: DataFrame, escaladas: DataFrame, resueltas: DataFrame) -> DataFrame:
    """``(documento_id, bloque_id)`` that need a person, each once: blocks of the first queue, and all blocks of the pages of the second."""
    uno = escaladas.where("requiere_revision_humana").select("documento_id", "bloque_id")
    p = resueltas.where("requiere_revision_humana").select("documento_id", "pagina").distinct()
    dos = bloques.select("documento_id", "pagina", F.col("id").alias("bloque_id")).join(p, ["documento_id", "pagina"], "left_semi").select("documento_id", "bloque_id")
    return uno.unionByName(dos).distinct()
