"""Translation: batches under a cap, answers, merges, glossary; the model's answers are a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.texto import primero_no_vacio, recortar


def mezclar(izquierda: DataFrame, derecha: DataFrame, clave: str = "id", valor: str = "contenido") -> DataFrame:
    """Answers of two halves of a batch; the right one wins where both have the key, even with a null."""
    j = izquierda.select(clave, F.col(valor).alias("i"), F.lit(True).alias("hi")).join(derecha.select(clave, F.col(valor).alias("d"), F.lit(True).alias("hd")), clave, "full")
    return j.select(clave, F.when(F.col("hd"), F.col("d")).otherwise(F.col("i")).alias(valor))


def mapa(traducciones: DataFrame, idioma: str) -> DataFrame:
    """``(documento_id, bloque_id, contenido)``: the translated text of each block in a language, a person's version first; blank ones are none."""
    t = traducciones.where(F.col("idioma") == idioma).select("documento_id", "bloque_id", primero_no_vacio(F.col("contenido_final"), F.col("contenido")).alias("contenido"))
    return t.where("contenido <> ''")


def recientes(traducciones: DataFrame, cuantas: int) -> DataFrame:
    """The newest translations, the larger id first on a tie; a top-k, never a full sort."""
    return traducciones.orderBy(F.desc_nulls_last("creado_en"), F.desc("id")).limit(cuantas)


def lotes_bajo_tope(lotes: DataFrame, tope: float) -> DataFrame:
    """``lotes(documento_id, lote, costo)`` with ``dentro``: the cost of the batches before is below the cap (0: none).

    One row per batch of twelve blocks, so a document's window is a twelfth of its blocks.
    """
    w = Window.partitionBy("documento_id").orderBy("lote").rowsBetween(Window.unboundedPreceding, -1)
    return lotes.withColumn("dentro", F.lit(tope <= 0) | (F.coalesce(F.sum("costo").over(w), F.lit(0.0)) < tope))


def glosario(terminos: DataFrame) -> DataFrame:
    """``(grupo, texto)``: the fixed translations of ``terminos(grupo, termino, traduccion)`` as lines of a prompt, by term; terms without one drop out."""
    t = terminos.where(recortar(F.col("traduccion")) != "").select("grupo", "termino", recortar(F.col("traduccion")).alias("traduccion"))
    return t.groupBy("grupo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("termino", "traduccion"))), lambda x: F.concat(F.lit("  "), x["termino"], F.lit(" → "), x["traduccion"])), "\n").alias("texto"))


# --- fixed values: sentences of the prompt ---------------------------------------------------------
AL_IDIOMA, DESCRIPCION = "Traducí al ", "El documento es: "
TERMINOS = "Respetá exactamente estas traducciones de términos, sin variar:\n"
CIERRE = "Conservá intactos los comandos LaTeX, las fórmulas entre $…$, los identificadores y los números. No agregues ni quites contenido."
# --- end of fixed values ---------------------------------------------------------------------------


def instrucciones(idioma: Column, descripcion: Column, tono: Column, terminos: Column) -> Column:
    """The prompt that goes with every batch: language, description, tone, glossary lines; blank parts drop out."""
    des = recortar(F.coalesce(descripcion, F.lit("")))
    partes = F.array(
        F.concat(F.lit(AL_IDIOMA), idioma, F.lit(".")), F.when(des != "", F.concat(F.lit(DESCRIPCION), des)), tono,
        F.when(F.coalesce(terminos, F.lit("")) != "", F.concat(F.lit(TERMINOS), terminos)), F.lit(CIERRE),
    )
    return F.array_join(F.array_compact(partes), "\n\n")


def respuestas(filas: DataFrame) -> DataFrame:
    """``(id, clave, contenido)`` of ``filas(id, respuesta)``: the pairs of the JSON list between the first ``[`` and the last ``]``.

    Elements without an id or a text, and answers that hold no list, give nothing.
    """
    lista = F.from_json(F.nullif(F.regexp_extract("respuesta", r"(?s)\[.*\]", 0), F.lit("")), "array<struct<id:string,texto:string>>")
    x = filas.select("id", F.explode(lista).alias("x")).where("x.id <> '' and x.texto is not null")
    return x.select("id", F.col("x.id").alias("clave"), F.col("x.texto").alias("contenido"))


def trabajar(bloques: DataFrame, respuestas_: DataFrame, costo_por_caracter: float, tope: float) -> tuple[DataFrame, DataFrame]:
    """A translation job: ``(traducciones(documento_id, bloque_id, contenido), estado(documento_id, lotes, hechos, truncado))``.

    Blocks to translate are cut into batches, batches are done while the cost of those
    before is below the cap, and answers ``(bloque_id, contenido)`` are joined to the blocks
    of done batches.  A job that the cap stopped is complete all the same, and marked.
    """
    from legajo.operators.revision import en_lotes, traducibles

    b = en_lotes(traducibles(bloques))
    n = lotes_bajo_tope(b.groupBy("documento_id", "lote").agg((F.sum(F.length("texto")) * costo_por_caracter).alias("costo")), tope)
    hechos = b.join(n.where("dentro"), ["documento_id", "lote"], "left_semi")
    t = hechos.select("documento_id", "bloque_id").join(respuestas_.select("bloque_id", "contenido"), "bloque_id").select("documento_id", "bloque_id", "contenido")
    e = n.groupBy("documento_id").agg(F.count("*").alias("lotes"), F.count_if("dentro").alias("hechos"))
    return t, e.withColumn("truncado", F.col("hechos") < F.col("lotes"))
