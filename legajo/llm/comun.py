"""Shared helpers of the training-data operators: reading, lineage cuts, Unicode forms."""

from __future__ import annotations

import pickle
import re
import unicodedata
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.sources.tablas import con_carpeta


def leer(spark: SparkSession, sf_dir: str, tabla: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{tabla}.parquet")


def fijar(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the session has or the cluster names in ``spark.checkpoint.dir``.
    """
    return con_carpeta(df).checkpoint(eager=True)


class Difundido:
    """A value for all tasks, sent by value with its classes: executors need not have the package."""

    def __init__(self, spark: SparkSession, valor: Any):
        self.b = spark.sparkContext.broadcast(cloudpickle.dumps(valor))

    @property
    def valor(self) -> Any:
        return pickle.loads(self.b.value)


# --- fixed values: letters of other scripts that display like a Latin letter -------------
PARECIDAS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԛ": "q", "ԝ": "w", "ԁ": "d", "ӏ": "l", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "ɑ": "a", "ɡ": "g", "ı": "ı", "µ": "μ", "‐": "-", "‑": "-", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
}
# --- end of fixed values -----------------------------------------------------------------


def _tabla_visual() -> dict[int, str | None]:
    """Code point → what it looks like: full-width to plain, any space to a space, invisible to nothing."""
    t: dict[int, str | None] = {ord(k): v for k, v in PARECIDAS.items()}
    for c in range(0xFF01, 0xFF5F):
        t[c] = chr(c - 0xFEE0)
    ignorables = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    for c in [*range(0x80, 0x10000), *range(0xE0000, 0xE0080)]:
        cat = unicodedata.category(chr(c))
        if cat == "Zs":
            t[c] = " "
        elif cat == "Cf" and not 0x600 <= c <= 0x6DD and c not in (0x70F, 0x8E2):
            t[c] = None
    t.update(dict.fromkeys(ignorables, None))
    t.update({0x2028: "\n", 0x2029: "\n", 0x85: "\n"})
    return t


TABLA_VISUAL = _tabla_visual()


def _clase_rara() -> re.Pattern:
    """Characters that the visual form may change, alone or once decomposed."""
    raras = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4 and (0x300 <= c < 0x370 or any(ord(x) in TABLA_VISUAL for x in unicodedata.normalize("NFD", chr(c))))]
    return re.compile("[" + "".join(map(re.escape, map(chr, raras))) + "]")


RARA = _clase_rara()
ALTA = re.compile("[\U00010000-\U0010ffff]")


def visual(s: str) -> str:
    """The form of ``s`` that keeps all a reader sees and nothing else (case, accents, digits, breaks, spaces stay)."""
    if "\r" in s:
        s = s.replace("\r\n", "\n").replace("\r", "\n")
    if s.isascii() or not RARA.search(s) and not ALTA.search(s) and unicodedata.is_normalized("NFC", s):
        return s
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(TABLA_VISUAL))


def forma_unica(s: str) -> str:
    """The comparison form: visual form, compatibility composed, fully case-folded, white space mapped.

    Two values with equal ``visual`` forms have equal comparison forms.
    """
    s = visual(s)
    if s.isascii():
        s = s.lower()
    else:
        s = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold()).translate(TABLA_VISUAL)
    return re.sub(r"[^\S\n]+", " ", s).strip()


def _tabla_sin_acentos() -> dict[str, str]:
    """Composed Latin letters and their base letter, from the canonical decompositions."""
    t = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and d[0].isalpha() and d[0].isascii():
            t[chr(c)] = d[0]
    return t


SIN_ACENTOS = _tabla_sin_acentos()


def clave_tipo(col):
    """A hand-written enumeration value without case, accents and outer white space (JVM expression)."""
    c = F.translate(col, "".join(SIN_ACENTOS), "".join(SIN_ACENTOS.values()))
    c = F.regexp_replace(c, r"\p{M}", "")
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
