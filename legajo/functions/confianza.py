"""Confidence scores as ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from legajo.functions.geometria import acotar
from legajo.functions.texto import puntaje_latex, recortar


def estructura(contenido: Column, es_formula: Column) -> Column:
    """1 for text with words, the structural score for a formula, 0 for nothing."""
    vacio = F.coalesce(recortar(contenido), F.lit("")) == ""
    return F.when(vacio, 0.0).when(es_formula, puntaje_latex(contenido)).otherwise(1.0)


def micro_segmento(engine: Column, contenido: Column, es_formula: Column, consenso: Column | None = None) -> Column:
    """Combined confidence; an invalid formula keeps three tenths of the engine's."""
    e = estructura(contenido, es_formula)
    c = F.lit(0.5) if consenso is None else F.coalesce(consenso, F.lit(0.5))
    return F.when(es_formula & (e == 0), 0.3 * engine).otherwise(acotar(0.4 * engine + 0.3 * e + 0.3 * c))


def pseudo(contenido: Column) -> Column:
    """Confidence of an engine that reports none: falls with the length, between 0.7 and 0.95."""
    return F.greatest(F.lit(0.7), F.least(F.lit(0.95), 0.95 - F.length(contenido) * 0.001))


def de_bloque(segmentos: Column) -> Column:
    """Mean structural confidence of the segments, clamped; 0 without any."""
    v = F.filter(F.transform(segmentos, lambda s: s["confianza_estructural"]), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, acotar(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))).otherwise(0.0)
