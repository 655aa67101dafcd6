"""Training-data operators.  Nothing outside this package imports it."""

from legajo.llm import calidad, comun, corte, escaneo, forma, fuga, idioma, tokens, toxicidad, truncado  # noqa: F401
