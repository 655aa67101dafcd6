"""Queries pN_... of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from legajo.llm import calidad, corte, escaneo, forma, fuga, idioma, tokens, toxicidad, truncado
from legajo.llm.comun import leer as t

VOCABULARIO = os.environ.get("TOKENIZADORES", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def queries():
    return {
        "p2_found": lambda s, d: corte.conservados(t(s, d, "ocr_resultados"), t(s, d, "bloques"), t(s, d, "umbrales")),
        "p2_cortes": lambda s, d: corte.informe_cortes(t(s, d, "ocr_resultados"), t(s, d, "bloques"), t(s, d, "umbrales")),
        "p3_found": lambda s, d: forma.pares_iguales_a_la_vista(t(s, d, "bloques")),
        "p3_formas": lambda s, d: forma.clases(t(s, d, "bloques")),
        "p3_enlaces": lambda s, d: forma.enlaces(t(s, d, "bloques")),
        "p1_found": lambda s, d: idioma.idiomas_no_nombrados(t(s, d, "documentos"), t(s, d, "bloques")),
        "p1_documentos": lambda s, d: idioma.idioma_de_documentos(t(s, d, "documentos"), t(s, d, "bloques")),
        "p1_pasajes": lambda s, d: idioma.pasajes(t(s, d, "documentos"), t(s, d, "bloques")),
        "p5_found": lambda s, d: escaneo.defectos(t(s, d, "bloques"), t(s, d, "ocr_resultados")),
        "p5_textos": lambda s, d: escaneo.reparados(t(s, d, "bloques"), t(s, d, "ocr_resultados")),
        "p6_found": lambda s, d: calidad.documentos_no_prosa(t(s, d, "bloques")),
        "p6_documentos": lambda s, d: calidad.informe_documentos(t(s, d, "documentos"), t(s, d, "bloques")),
        "p4_found": lambda s, d: truncado.cortados(t(s, d, "decisiones"), t(s, d, "bloques")),
        "p4_tasas": lambda s, d: truncado.tasas(t(s, d, "decisiones"), t(s, d, "bloques")),
        "p7_ids": lambda s, d: tokens.codificar_corpus(t(s, d, "documents"), VOCABULARIO),
        "p8_found": lambda s, d: fuga.fugas(t(s, d, "documents"), t(s, d, "benchmark")).where("distancia = 0").select("doc_id", "item_id"),
        "p9_found": lambda s, d: toxicidad.hallados(t(s, d, "documents"), t(s, d, "labels")),
        "p9_puntajes": lambda s, d: toxicidad.puntajes(t(s, d, "documents"), t(s, d, "labels")),
        "p9_tasas": lambda s, d: toxicidad.tasas(t(s, d, "documents"), t(s, d, "labels")),
        "p8_items": lambda s, d: fuga.informe_items(t(s, d, "documents"), t(s, d, "benchmark")),
    }


def oracle_sql():
    return {**corte.SQL}
