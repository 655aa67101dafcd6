"""Boxes and page geometry as ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def acotar(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def normalizar(x: Column, tamano: Column) -> Column:
    """Coordinate as a share of the page, clamped; a page without size gives 0."""
    return F.when(tamano > 0, acotar(x / tamano)).otherwise(0.0)


def desnormalizar(x: Column, tamano: Column) -> Column:
    """Share of the page as a whole pixel inside the image, truncated toward zero."""
    return F.greatest(F.lit(0), F.least((x * tamano).cast("int"), tamano.cast("int")))


def pixeles(puntos: Column, dpi: int = 150) -> Column:
    return F.floor(puntos * dpi / 72)
