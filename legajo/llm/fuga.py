"""Held-out items whose passages occur in the corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.comun import TABLA_VISUAL, Difundido

VENTANA = 10
PALABRA = re.compile(r"[^\W_]+")
GUION = re.compile(r"[-¬\u00ad\u2010\u2011]([ \t>*]*\n[ \t>*]*)(?=\w)")
MARCA = re.compile(r"\\[A-Za-z]+\*?|</?[A-Za-z][^<>]*>|&[A-Za-z]+;|&#\w+;")


def _palabras_de_trozo(t: str) -> list[str]:
    """Words of a piece without white space: folded, without accents, look-alikes mapped."""
    if t.isascii():
        return PALABRA.findall(t.lower())
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFD", t).translate(TABLA_VISUAL)).casefold()
    return PALABRA.findall("".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def trozos(s: str, unir: bool = True) -> list[str]:
    """White-space separated pieces of a text without markup, line-end hyphens joined (or split)."""
    if "\n" in s:
        s = GUION.sub("" if unir else " ", s)
    if "\\" in s or "<" in s or "&" in s:
        s = MARCA.sub(" ", s)
    return s.split()


def palabras(s: str, unir: bool = True) -> list[str]:
    return [p for t in trozos(s, unir) for p in _palabras_de_trozo(t)]


class Caminata:
    """CGK embedding of word windows and bit-sampling LSH over it.

    Each of ``repeticiones`` walks has its own random bits: step j copies the symbol at the
    walk's position and moves on by a bit drawn from (j, symbol), which turns a small edit
    distance of two windows into a small Hamming distance of their embeddings.  A bucket is
    the hash of the symbols at ``muestra`` sampled steps.  Equal windows have equal
    embeddings, so they always meet.
    """

    def __init__(self, n_simbolos: int, ventana: int, repeticiones: int, muestra: int, semilla: int = 7):
        g = np.random.default_rng(semilla)
        self.ventana, self.pasos = ventana, 2 * ventana
        self.bits = g.integers(0, 2, (repeticiones, self.pasos, n_simbolos + 1), dtype=np.int8)
        self.muestras = [set(g.choice(self.pasos, muestra, replace=False).tolist()) for _ in range(repeticiones)]
        self.mult = g.integers(1, 2**62, (repeticiones, self.pasos), dtype=np.int64) | 1

    def cubetas(self, x: np.ndarray, inicio: np.ndarray) -> np.ndarray:
        """(repetitions, windows) bucket keys of the windows x[inicio : inicio + ventana]."""
        relleno = self.bits.shape[2] - 1
        salida = np.zeros((len(self.muestras), len(inicio)), np.int64)
        with np.errstate(over="ignore"):
            for r, muestra in enumerate(self.muestras):
                pos = np.zeros(len(inicio), np.int64)
                for j in range(self.pasos):
                    sim = np.where(pos < self.ventana, x[np.minimum(inicio + pos, len(x) - 1)], relleno)
                    if j in muestra:
                        salida[r] += (sim + 1) * self.mult[r, j]
                    pos += self.bits[r, j][sim]
                salida[r] = (salida[r] ^ (salida[r] >> 29)) * np.int64(-7046029254386353131) + r
        return salida


def distancia_edicion(a: list[int], b: list[int]) -> int:
    if list(a) == b:
        return 0
    fila = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, fila[0] = fila[0], i
        for j, y in enumerate(b, 1):
            diag, fila[j] = fila[j], min(fila[j] + 1, fila[j - 1] + 1, diag + (x != y))
    return fila[-1]


def fugas(
    corpus: DataFrame, items: DataFrame, id_col: str = "doc_id", texto: str = "text", item_col: str = "item_id", item_texto: str = "text",
    ventana: int = VENTANA, ediciones: int = 1, repeticiones: int = 6, muestra: int = 6, max_mb: int = 200,
) -> DataFrame:
    """``(id, item, distancia)``: the smallest word edit distance of a window of the document to one of the item, up to ``ediciones``.

    Windows of ``ventana`` words of every document are embedded and looked up in the
    buckets of the items' windows; candidates are verified by edit distance, exactly.
    Distance 0 means ``ventana`` consecutive words of the item, and is found always; recall
    at distance 1 is above 0.9 with the defaults (tested).

    Windows with more than ``ediciones`` words outside the items' vocabulary cannot come
    within the distance and are left out before embedding.  No shuffle before the verified
    pairs; the items' windows are collected and broadcast as arrays: per window its words,
    and its bucket and number for each repetition.  Their size is bounded by ``max_mb`` (an
    item text of n bytes has at most n / 2 words and two windows a word); a larger set of
    items is processed in slices, each over the whole corpus.

    Items shorter than the window, null and empty texts give no row; repeated rows of
    either table change nothing; documents may be arbitrarily long.
    """
    ti, td = items.schema[item_col].dataType.simpleString(), corpus.schema[id_col].dataType.simpleString()
    it = items.where(F.col(item_texto).isNotNull() & F.col(item_col).isNotNull()).select(item_col, item_texto).distinct()
    bytes_ventana = 4 * ventana + 12 * repeticiones + 16
    mb = (it.agg(F.sum(F.octet_length(item_texto))).first()[0] or 0) * bytes_ventana / 1e6
    rebanadas = max(1, int(np.ceil(mb / max_mb)))
    salida = None
    for k in range(rebanadas):
        parte = it if rebanadas == 1 else it.where(F.pmod(F.xxhash64(item_col), F.lit(rebanadas)) == k)
        filas = parte.collect()  # a slice: its text is smaller than its windows
        vocab: dict[str, int] = {}
        ventanas: dict[tuple, set] = {}
        for r in filas:
            for unir in (True, False):
                w = [vocab.setdefault(p, len(vocab) + 1) for p in palabras(r[1], unir)]
                for i in range(len(w) - ventana + 1):
                    ventanas.setdefault(tuple(w[i : i + ventana]), set()).add(r[0])
        claves = np.array(list(ventanas), np.int32).reshape(-1, ventana)
        de_items = [sorted(x) for x in ventanas.values()]
        cam = Caminata(len(vocab) + 1, ventana, repeticiones, muestra)
        cub = cam.cubetas(claves.ravel().astype(np.int64), np.arange(len(claves)) * ventana).ravel() if len(claves) else np.zeros(0, np.int64)
        orden = np.argsort(cub, kind="stable")
        # sorted buckets, and the window of each entry
        datos = Difundido(corpus.sparkSession, (vocab, claves, de_items, cub[orden], (orden % max(1, len(claves))).astype(np.int32), cam))

        def tarea(lotes: Iterator[pa.RecordBatch], datos=datos) -> Iterator[pa.RecordBatch]:
            vocab, claves, de_items, cub, de_cub, cam = datos.valor
            de = vocab.get
            vistos: dict[str, list[int]] = {}  # piece of text → codes of its words
            for lote in lotes:
                if not len(claves):
                    continue
                if len(vistos) > 400_000:
                    vistos.clear()
                codigos: list[int] = []
                dueno: list[int] = []
                for n, t in enumerate(lote.column(1).to_pylist()):
                    if not t:
                        continue
                    for unir in (True, False) if "\n" in t and GUION.search(t) else (True,):
                        antes = len(codigos)
                        for x in trozos(t, unir):
                            c = vistos.get(x)
                            if c is None:
                                c = vistos[x] = [de(p, 0) for p in _palabras_de_trozo(x)]
                            codigos += c
                        codigos += [0] * ventana  # windows do not run on into the next text
                        dueno += [n] * (len(codigos) - antes)
                if not codigos:
                    continue
                x = np.array(codigos, np.int64)
                fuera = np.concatenate([[0], np.cumsum(x == 0)])
                n_v = len(x) - ventana + 1
                inicio = np.flatnonzero(fuera[ventana:] - fuera[:n_v] <= ediciones)
                mejor: dict[tuple, int] = {}
                vistas: dict[tuple, list] = {}
                if len(inicio):
                    for fila in cam.cubetas(x, inicio):
                        p, q = np.searchsorted(cub, fila), np.searchsorted(cub, fila, "right")
                        for i in np.flatnonzero(p < q):
                            s = int(inicio[i])
                            v = tuple(codigos[s : s + ventana])
                            k2 = (v, int(fila[i]))
                            if k2 not in vistas:
                                vistas[k2] = [(m, d) for m in de_cub[p[i] : q[i]].tolist() if (d := distancia_edicion(v, claves[m].tolist())) <= ediciones]
                            for m, d in vistas[k2]:
                                for item in de_items[m]:
                                    k3 = (dueno[s], item)
                                    if d < mejor.get(k3, ediciones + 1):
                                        mejor[k3] = d
                if mejor:
                    ids = lote.column(0).take(pa.array([k[0] for k in mejor], pa.int64()))
                    yield pa.RecordBatch.from_pydict({"d": ids, "i": pa.array([k[1] for k in mejor]), "n": pa.array(list(mejor.values()), pa.int32())})

        r = corpus.where(F.col(id_col).isNotNull()).select(id_col, texto).mapInArrow(tarea, f"d {td}, i {ti}, n int")
        salida = r if salida is None else salida.unionByName(r)
    return salida.groupBy(F.col("d").alias(id_col), F.col("i").alias(item_col)).agg(F.min("n").alias("distancia"))


def informe_items(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, n_docs, n_docs_cercanos)``: documents with a passage of the item, and with one at a small distance only; items without any have 0."""
    f = fugas(corpus, items)
    return (
        items.select("item_id").distinct().join(f, "item_id", "left").groupBy("item_id")
        .agg(F.count_if(F.col("distancia") == 0).alias("n_docs"), F.count_if(F.col("distancia") > 0).alias("n_docs_cercanos"))
    )
