"""Encoding of a corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# --- fixed values: pre-tokenisation pattern of the byte_bpe vocabularies ------------------
PATRON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --- end of fixed values -----------------------------------------------------------------


def leer_rangos(ruta: str) -> dict[bytes, int]:
    with open(ruta, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TrieBpe:
    """Encodes distinct words by one depth-first walk over their trie.

    A node of the trie is a prefix of some word; its state is the last token of the
    encoding of that prefix.  The state follows from the states of the shorter prefixes
    alone: it is the one vocabulary entry t that ends the prefix such that t may follow
    the last token of what stands before it, i.e. merging both byte strings by rank
    gives back exactly these two tokens.  Sorted words are the depth-first order of the
    trie, so the states on the path to the common prefix of two neighbours are kept and
    each shared prefix is computed once.
    """

    def __init__(self, rangos: dict[bytes, int]):
        self.rangos = rangos
        self.bytes_de = {i: b for b, i in rangos.items()}
        largos: dict[bytes, set[int]] = {}
        for b in rangos:
            largos.setdefault(b[-2:], set()).add(len(b))
        self.largos = {k: sorted(v, reverse=True) for k, v in largos.items()}
        self.pares: dict[tuple[int, int], bool] = {}

    def fusionar(self, b: bytes) -> list[int]:
        """The merges by rank themselves, for short byte strings."""
        partes = [b[i : i + 1] for i in range(len(b))]
        while len(partes) > 1:
            mejor, donde = None, -1
            for i in range(len(partes) - 1):
                r = self.rangos.get(partes[i] + partes[i + 1])
                if r is not None and (mejor is None or r < mejor):
                    mejor, donde = r, i
            if mejor is None:
                break
            partes[donde : donde + 2] = [partes[donde] + partes[donde + 1]]
        return [self.rangos[p] for p in partes]

    def sigue(self, a: int, t: int) -> bool:
        """May token t follow token a (a = -1: start of the word)?"""
        k = (a, t)
        r = self.pares.get(k)
        if r is None:
            r = self.pares[k] = self.fusionar((self.bytes_de[a] if a >= 0 else b"") + self.bytes_de[t]) == ([a, t] if a >= 0 else [t])
        return r

    def codificar(self, palabras: Iterable[bytes]) -> dict[bytes, list[int]]:
        salida: dict[bytes, list[int]] = {}
        estado = [-1]  # estado[i]: last token of the encoding of the first i bytes of the path
        antes = b""
        rangos, largos, bytes_de = self.rangos, self.largos, self.bytes_de
        for w in sorted(palabras):
            comun, tope = 0, min(len(antes), len(w))
            while comun < tope and antes[comun] == w[comun]:
                comun += 1
            del estado[comun + 1 :]
            for i in range(comun + 1, len(w) + 1):
                fin = w[max(0, i - 2) : i]
                vistos = largos.get(fin, ()) if i > 1 else ()
                for n in (*vistos, 1) if 1 not in vistos else vistos:
                    if n > i:
                        continue
                    t = rangos.get(w[i - n : i])
                    if t is not None and self.sigue(estado[i - n], t):
                        estado.append(t)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, i = [], len(w)
            while i:
                t = estado[i]
                ids.append(t)
                i -= len(bytes_de[t])
            salida[w] = ids[::-1]
            antes = w
        return salida


def codificar_corpus(df: DataFrame, ruta: str, id_col: str = "doc_id", texto: str = "text", cache_palabras: int = 400_000) -> DataFrame:
    """One row ``(id, ids array<int>)`` per row of ``df``; a null or empty text has the empty list.

    ``ruta``: the vocabulary file, read in the driver.  No shuffle: each task keeps the encodings of the distinct words it has met; when there
    are more than ``cache_palabras`` they are forgotten (memory only, results stay).  The
    vocabulary (fixed size, about 50k entries) is broadcast.  Special-token strings are
    ordinary text.  Texts may be arbitrarily long; blank texts are encoded like any other.
    Repeated rows give repeated rows, an empty table an empty one.
    """
    sc = df.sparkSession.sparkContext
    rangos = sc.broadcast(leer_rangos(ruta))
    tipo = df.schema[id_col].dataType.simpleString()

    def tarea(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TrieBpe(rangos.value)
        partir = regex.compile(PATRON).findall
        conocidas: dict[str, list[int]] = {}
        for lote in lotes:
            for desde in range(0, lote.num_rows, 1000):
                parte = lote.slice(desde, 1000)
                trozos = [partir(t) if t else [] for t in parte.column(1).to_pylist()]
                nuevas = set().union(*trozos).difference(conocidas)
                if len(conocidas) > cache_palabras:
                    conocidas.clear()
                    nuevas = set().union(*trozos)
                if nuevas:
                    de = {w.encode("utf-8", "surrogatepass"): w for w in nuevas}
                    for b, ids in trie.codificar(de).items():
                        conocidas[de[b]] = ids
                if len(trie.pares) > 4 * cache_palabras:
                    trie.pares.clear()
                ids: list[int] = []
                cortes = [0]
                for t in trozos:
                    for w in t:
                        ids += conocidas[w]
                    cortes.append(len(ids))
                yield pa.RecordBatch.from_arrays([parte.column(0), pa.ListArray.from_arrays(pa.array(cortes, pa.int32()), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    return df.select(id_col, texto).mapInArrow(tarea, f"`{id_col}` {tipo}, ids array<int>")
