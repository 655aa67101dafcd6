"""Language of documents and of passages within them: a linear-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.comun import SIN_ACENTOS, Difundido, forma_unica, visual

IDIOMAS = ("es", "en", "fr", "de", "pt")
NINGUNO = len(IDIOMAS)  # the label of words that are in no language
CUBOS = 1 << 15
MIN_PALABRAS = 12
MAX_DOCS, MAX_BLOQUES_DOC = 80, 4  # training sample: documents per label, blocks per document
MAX_LARGO = 100_000  # characters of a block of the training sample
TROZO_MAX = 60  # longer training sentences are learned in pieces
MIN_INSERTO = 3  # words of another language within a sentence from which they are a segment of their own

# --- fixed values: names and codes of the languages, lower case without accents -------------
NOMBRES = {
    "es": "es spa esp cas espanol espanola castellano spanish castilian spanisch espagnol espagnole espanhol espanhola castelhano castillan kastilisch spagnolo espanyol castella spaans",
    "en": "en eng ing ang ingles inglesa english englisch anglais anglaise inglese angles engels",
    "fr": "fr fra fre frances francesa french franzosisch franzoesisch francais francaise francese frans",
    "de": "de deu ger ale aleman alemana german deutsch allemand allemande alemao alema tedesco alemany duits",
    "pt": "pt por portugues portuguesa portuguese portugiesisch portugais portugaise portoghese portugees",
}
# --- fixed values: common function words ------------------------------------------------------
FUNCIONALES = {
    "es": "el la los las un una de del que y en se con por para es no lo como al entonces según cuando pero aunque donde este esta todo más su",
    "en": "the a an of and to in is that for with by on which we this from as are be it not then when but every all their has",
    "fr": "le la les un une de des du que et en dans est pour par sur avec nous on qui ne pas ce cette alors lorsque mais tout plus son aux",
    "de": "der die das den dem des ein eine einen und ist nicht mit von für auf dass sich wenn dann wir auch nach zu im aber jede noch man durch",
    "pt": "o a os as um uma de do da dos das que e em se com por para não é como ao então quando mas embora onde este esta todo mais seu na no",
}
# --- end of fixed values ----------------------------------------------------------------------
_DE_NOMBRE = {n: k for k, v in NOMBRES.items() for n in v.split()}
_LEXICO: dict[str, list[int]] = {}
for _k, _v in FUNCIONALES.items():
    for _w in _v.split():
        _LEXICO.setdefault(_w, []).append(IDIOMAS.index(_k))
_ACENTOS = str.maketrans(SIN_ACENTOS)


def idiomas_nombrados(etiqueta: str | None) -> list[str]:
    """Languages that a hand-written label names, by code or name in any language; none for an unusable label."""
    if not etiqueta:
        return []
    s = forma_unica(etiqueta).translate(_ACENTOS)
    m = re.match(r"^[\W_]*([a-z]{2,3})[-_][a-z0-9-_]+[\W_]*$", s)
    trozos = [m[1]] if m else re.findall(r"[^\W\d_]+", s)
    return sorted({_DE_NOMBRE[t] for t in trozos if t in _DE_NOMBRE})


_GUION = re.compile(r"(?<=[^\W\d_])[-¬­‐‑][ \t]*\n[ \t]*(?=[^\W\d_])")
_FUERA = re.compile(r"\$[^$]*\$|\\\[.*?\\\]|\\begin\{(\w+\*?)\}.*?\\end\{\1\}|```.*?```|\\[A-Za-z]+(?:\{[^{}]*\})*", re.S)
_COMILLAS = re.compile(r"«([^«»]*)»|“([^“”]*)”|„([^„“]*)“|\"([^\"\n]*)\"")
_ENTRADA = re.compile(r"^[ \t]*(?:[-•·*▪‣◦–+]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)])[ \t]+")
_INDICE = re.compile(r"(?:,\s*\d{1,5})+\s*$|(?:\. ?){4,}\s*\d*\s*$")
_PALABRA = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_VOCAL = re.compile(r"[aeiouyàáâãäåèéêëìíîïòóôõöùúûüæœ]")
_FRASE = re.compile(r"[^.!?…:]*[.!?…:]+[»”\"')\]]*(?=\s|$)|[^.!?…:]+$|[^.!?…:]*[.!?…:]", re.S)
_FIN = re.compile(r"[.!?…][»”\"')\]∎ ]*$")
_VALOR_ABSOLUTO = re.compile(r"(?<![^\s(\[{=<>≤≥+−*/,-])\|[^\s|](?:[^|]*[^\s|])?\|(?![^\s)\]}=<>≤≥+−*/.,;:!?^_-])")
_SEPARADORES = (("\t", 1), ("|", 2), ("&", 1), (";", 2))  # a table row holds more than so many
_SUELTAS = frozenset("a e o y u i à é ó".split())


def _sin_titulo(m: re.Match) -> str:
    t = next((g for g in m.groups() if g is not None), "")
    return t if len(_PALABRA.findall(t)) >= MIN_PALABRAS else " "


def _palabras(t: str) -> list[str]:
    return [x for x in _PALABRA.findall(t.lower()) if len(x) > 1 or x in _SUELTAS]


def _variada(w: list[str]) -> bool:
    """Words repeated over and over are no sentence."""
    return len(set(w)) * 3 > len(w)


def _es_fila(linea: str) -> bool:
    """Is the line a table row?  It holds separators, not only absolute values, and stands between bars or has no cell of prose."""
    for sep, n in _SEPARADORES:
        if linea.count(sep) <= n:
            continue
        s = _VALOR_ABSOLUTO.sub(" ", linea) if sep == "|" else linea
        if s.count(sep) <= n:
            continue
        if sep == "|" and s.strip()[0] == s.strip()[-1] == "|":
            return True
        if not any(len(_PALABRA.findall(c)) >= MIN_PALABRAS or any(_FIN.search(f) and len(_PALABRA.findall(f)) >= 4 for f in _FRASE.findall(c)) for c in s.split(sep)):
            return True
    return False


def frases(texto: str) -> list[tuple[list[str], bool]]:
    """``(words, is a sentence of running text)`` of a block; formulas, code and quoted titles give none, list entries and table rows only as 12 words up to a full stop."""
    s = visual(texto) if not texto.isascii() else texto
    if "\n" in s:
        s = _GUION.sub("", s)
    if "$" in s or "\\" in s or "`" in s:
        s = _FUERA.sub(" ", s)
    if "«" in s or "“" in s or '"' in s:
        s = _COMILLAS.sub(_sin_titulo, s)
    salida: list[tuple[list[str], bool]] = []
    prosa: list[str] = []

    def vaciar():
        if prosa:
            for f in _FRASE.findall(" ".join(prosa)):
                w = _palabras(f)
                if w:
                    salida.append((w, (len(w) >= MIN_PALABRAS or bool(_FIN.search(f))) and _variada(w)))
            prosa.clear()

    for linea in s.split("\n"):
        if _ENTRADA.match(linea) or _es_fila(linea) or _INDICE.search(linea) and len(_palabras(linea)) <= 8:
            vaciar()
            # as a whole it counts or not; its sentences are labelled one by one
            w = [x for x in map(_palabras, _FRASE.findall(linea)) if x]
            salida += [(x, sum(map(len, w)) >= MIN_PALABRAS and bool(_FIN.search(linea)) and _variada(x)) for x in w]
        else:
            prosa.append(linea)
    vaciar()
    return salida


def rasgos(w: str) -> list[int]:
    """Hashed features of a word: itself, affixes, inner n-grams, and whether it has a vowel."""
    p = f"<{w}>"
    f = ["w" + w] + ["p" + w[:i] for i in (1, 2, 3, 4)] + ["s" + w[-i:] for i in (1, 2, 3, 4)]
    f += ["2" + p[i : i + 2] for i in range(len(p) - 1)] + ["3" + p[i : i + 3] for i in range(len(p) - 2)]
    if not _VOCAL.search(w):
        f.append(f"0{min(len(w), 4)}")
    return [zlib.crc32(x.encode("utf-8", "replace")) % CUBOS for x in f]


def sin_idioma(n: int, palabras: list[str], semilla: int = 9) -> list[list[str]]:
    """``n`` made-up texts in no language: random letters of several alphabets with and without vowels, encoded bytes, mis-decoded letters, jumbled letters of real words."""
    g = np.random.default_rng(semilla)
    latin = [chr(c) for c in range(0xA1, 0x180) if chr(c).isalpha()]
    cifrado = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    consonantes, letras = list("bcdfghjklmnpqrstvwxz"), list("abcdefghijklmnopqrstuvwxyz")
    al_azar = lambda abc, a, b: "".join(g.choice(abc, int(g.integers(a, b)))) if abc else ""
    salida = []
    for i in range(n):
        largo = int(g.integers(8, 40))
        clase = i % 6
        if clase == 0:
            w = [al_azar(letras + ["'", "~", "1"], 1, 10) for _ in range(largo)]
        elif clase == 1:
            w = [al_azar(consonantes, 2, int(g.integers(3, 9))) for _ in range(largo)]
        elif clase == 2:
            abc = g.choice(latin, 12).tolist()
            w = [al_azar(abc, 1, 8) for _ in range(largo)]
        elif clase == 3:
            w = ["".join(g.choice(cifrado, int(g.integers(40, 240))))]
        elif clase == 4 and palabras:
            w = ["".join(g.permutation(list(x))) for x in g.choice(palabras, largo).tolist()]
        else:
            sufijos = [al_azar(letras, 2, 4) for _ in range(4)]
            w = [al_azar(consonantes, 1, 4) + (str(g.choice(sufijos)) if g.random() < 0.5 else str(g.integers(0, 10)) + al_azar(letras, 0, 2)) for _ in range(largo)]
        t = [y for x in w for y in _palabras(x)]
        if len(t) >= 4:
            salida.append(t)
    return salida


class Crf:
    """Feature weights by label (the languages, and none), lexicon weights, transitions; ``umbral``: least confidence of a passage."""

    umbral = 0.7

    def __init__(self):
        k = NINGUNO + 1
        self.w = np.zeros((CUBOS, k), np.float32)
        self.lex = np.float32(1.5)
        self.trans = np.full((k, k), -2.0, np.float32)
        np.fill_diagonal(self.trans, 1.0)

    def emision(self, w: str) -> np.ndarray:
        f = rasgos(w)
        e = self.w[f].sum(0) / np.float32(len(f) ** 0.5)
        for k in _LEXICO.get(w, ()):
            e[k] += self.lex
        return e

    def marginales(self, e: np.ndarray, vale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over (n, T, K) emissions: label marginals, and summed transition marginals."""
        n, t, k = e.shape
        pe = np.exp(e - e.max(2, keepdims=True))
        tr = np.exp(self.trans)
        al = np.empty((t, n, k), np.float32)
        a = pe[:, 0] / pe[:, 0].sum(1, keepdims=True)
        al[0] = a
        for i in range(1, t):
            b = (a @ tr) * pe[:, i]
            b /= b.sum(1, keepdims=True)
            a = np.where(vale[:, i : i + 1], b, a)
            al[i] = a
        be = np.ones((n, k), np.float32)
        m = np.empty((n, t, k), np.float32)
        pares = np.zeros((k, k))
        for i in range(t - 1, -1, -1):
            g = al[i] * be
            m[:, i] = g / g.sum(1, keepdims=True)
            if i:
                pb = pe[:, i] * be
                v = vale[:, i]
                x = al[i - 1][:, :, None] * tr[None] * pb[:, None, :]
                if v.any():
                    x = x[v] / x[v].sum((1, 2), keepdims=True)
                    pares += x.sum(0)
                b = pb @ tr.T
                b /= b.sum(1, keepdims=True)
                be = np.where(v[:, None], b, be)
        return m, pares

    def solo_marginales(self, e: np.ndarray, vale: np.ndarray) -> np.ndarray:
        n, t, k = e.shape
        pe = np.exp(e - e.max(2, keepdims=True))
        tr = np.exp(self.trans)
        al = np.empty((t, n, k), np.float32)
        a = al[0] = pe[:, 0] / pe[:, 0].sum(1, keepdims=True)
        for i in range(1, t):
            b = (a @ tr) * pe[:, i]
            b /= b.sum(1, keepdims=True)
            a = al[i] = np.where(vale[:, i : i + 1], b, a)
        be = np.ones((n, k), np.float32)
        for i in range(t - 1, 0, -1):
            b = (pe[:, i] * be) @ tr.T
            b /= b.sum(1, keepdims=True)
            al[i] *= be
            be = np.where(vale[:, i : i + 1], b, be)
        al[0] *= be
        al /= al.sum(2, keepdims=True)
        return al.transpose(1, 0, 2)


def entrenar(ejemplos: list[tuple[list[str], int]], epocas: int = 30, semilla: int = 3) -> Crf:
    """Fit on (words, label) sentences of four words or more; half are joined to code-switched pairs, so that switches are learned too.

    In each epoch every label has the same number of sentences; to the languages comes
    generated text in none.  Sentences of wrong or mixed documents are left out: those with
    more function words of another language than of their own, and after a first fit those
    that the field contradicts; then it is fitted again.  A fifth
    of the sentences is held out and sets ``umbral``.
    """
    crf = Crf()
    ejemplos = [(w, k) for w, k in ejemplos if len(w) >= 4]
    if ejemplos:
        ejemplos += [(w, NINGUNO) for w in sin_idioma(max(40, len(ejemplos) // 2), sorted({x for w, _ in ejemplos for x in w if len(x) > 3}))]
        ejemplos = [x for x in ejemplos if _creible(*x)]
    prueba = [x for x in ejemplos if zlib.crc32(" ".join(x[0]).encode("utf-8", "replace")) % 5 == 0]
    ejemplos = [(w[i : i + TROZO_MAX], k) for w, k in ejemplos if zlib.crc32(" ".join(w).encode("utf-8", "replace")) % 5 for i in range(0, len(w), TROZO_MAX)]
    if not ejemplos:
        return crf
    g = np.random.default_rng(semilla)
    voc: dict[str, int] = {}
    cod = [[voc.setdefault(x, len(voc)) for x in w] for w, _ in ejemplos]
    filas = [rasgos(x) for x in voc]
    largo = np.array([len(f) for f in filas])
    plano = np.concatenate([np.array(f) for f in filas])
    uso, inv = np.unique(plano, return_inverse=True)
    ini = np.concatenate([[0], np.cumsum(largo)[:-1]])
    raiz = np.sqrt(largo)[:, None].astype(np.float32)
    lex = np.zeros((len(voc), NINGUNO + 1), np.float32)
    for x, i in voc.items():
        for k in _LEXICO.get(x, ()):
            lex[i, k] = 1
    et = np.array([k for _, k in ejemplos])
    vivos = np.arange(len(ejemplos))
    for vuelta in range(2):
        w = crf.w[uso]
        m1, m2, m3, m4 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(crf.trans), np.zeros_like(crf.trans)
        for ep in range(1, epocas + 1):
            # as many of each label, about the size of the sample in all
            por_clase = [v for k in range(NINGUNO + 1) if len(v := vivos[et[vivos] == k])]
            o = g.permutation(np.concatenate([np.resize(g.permutation(v), -(-len(vivos) // len(por_clase))) for v in por_clase]))
            pares = list(zip(o[::2], o[1::2])) if len(o) > 1 else [(o[0], o[0])]
            sec, met = [], []
            for n, (i, j) in enumerate(pares):
                if n % 2:
                    sec.append(cod[i] + cod[j])
                    met.append([et[i]] * len(cod[i]) + [et[j]] * len(cod[j]))
                else:
                    sec += [cod[i], cod[j]]
                    met += [[et[i]] * len(cod[i]), [et[j]] * len(cod[j])]
            t = max(map(len, sec))
            idx, vale, y = np.zeros((len(sec), t), np.int64), np.zeros((len(sec), t), bool), np.zeros((len(sec), t), np.int64)
            for n, (s, m) in enumerate(zip(sec, met)):
                idx[n, : len(s)], vale[n, : len(s)], y[n, : len(s)] = s, True, m
            emi = np.add.reduceat(w[inv], ini, axis=0) / raiz + crf.lex * lex
            mar, pt = crf.marginales(emi[idx], vale)
            d = mar.copy()
            np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
            d *= vale[:, :, None]
            por_palabra = np.zeros((len(voc), NINGUNO + 1), np.float32)
            for k in range(NINGUNO + 1):
                por_palabra[:, k] = np.bincount(idx.ravel(), d[:, :, k].ravel(), len(voc))
            tot = vale.sum()
            gw = np.zeros_like(w)
            rep = np.repeat(por_palabra / raiz, largo, axis=0)
            for k in range(NINGUNO + 1):
                gw[:, k] = np.bincount(inv, rep[:, k], len(uso))
            gw = gw / tot + 1e-6 * w
            real = np.zeros_like(crf.trans)
            v2 = vale[:, 1:]
            np.add.at(real, (y[:, :-1][v2], y[:, 1:][v2]), 1)
            gt = (pt - real) / tot + 1e-4 * crf.trans
            m1 += 0.1 * (gw - m1)
            m2 += 0.01 * (gw * gw - m2)
            m3 += 0.1 * (gt - m3)
            m4 += 0.01 * (gt * gt - m4)
            c1, c2 = 1 - 0.9**ep, 1 - 0.99**ep
            w -= (0.15 * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-7)).astype(np.float32)
            crf.trans -= (0.05 * (m3 / c1) / (np.sqrt(m4 / c2) + 1e-7)).astype(np.float32)
        crf.w[uso] = w
        if not vuelta:
            emi = np.add.reduceat(w[inv], ini, axis=0) / raiz + crf.lex * lex
            bien = np.array([int(emi[c].sum(0).argmax()) == k for c, k in zip(cod, et)])
            vivos = np.flatnonzero(bien) if bien.any() else vivos
    crf.umbral = elegir_umbral(crf, prueba)
    return crf


def _creible(palabras: list[str], k: int) -> bool:
    """Does no other language have more function words in the sentence than its label?"""
    n = np.zeros(NINGUNO + 1)
    for w in palabras:
        for j in _LEXICO.get(w, ()):
            n[j] += 1
    return k == NINGUNO or n[k] >= n.max()


def elegir_umbral(crf: Crf, prueba: list[tuple[list[str], int]], precision: float = 0.995, desde: float = 0.6, hasta: float = 0.95) -> float:
    """Least confidence at which held-out text in no language is taken for one in a language in at most 1 - ``precision`` of the passages.

    Only text in no language counts as wrong: a part of the labels of the sample is.
    """
    conf, mal = [], []
    for w, k in prueba:
        m = crf.solo_marginales(np.array([[crf.emision(x) for x in w]], np.float32), np.ones((1, len(w)), bool))[0].sum(0)
        if (j := int(m.argmax())) != NINGUNO:
            conf.append(m[j] / len(w))
            mal.append(k == NINGUNO)
    if not conf:
        return 0.7
    c, f = np.array(conf), np.array(mal)
    return next((float(u) for u in np.arange(desde, hasta, 0.05) if f[c >= u].sum() <= (1 - precision) * (c >= u).sum()), hasta)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nombrados(lotes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in lotes:
        de = {v: idiomas_nombrados(v) for v in s.dropna().unique()}
        yield pd.Series([de.get(v, []) for v in s], dtype=object)


def muestra(documentos: DataFrame, bloques: DataFrame, max_docs: int = MAX_DOCS, max_bloques: int = MAX_BLOQUES_DOC) -> list[tuple[list[str], int]]:
    """Labelled sentences of about ``max_docs`` documents per language and ``max_bloques`` blocks of each, chosen by hash."""
    d = documentos.where("id is not null").select("id", nombrados("idioma_original").alias("k")).where("size(k) = 1").select("id", F.col("k")[0].alias("k")).distinct()
    n = {r.k: r["count"] for r in d.groupBy("k").count().collect()}  # five rows
    if not n:
        return []
    umbral = F.coalesce(*[F.when(F.col("k") == k, F.lit(int(1e6 * min(1.0, max_docs / c)))) for k, c in n.items()])
    d = d.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < umbral)
    w = Window.partitionBy("documento_id").orderBy(F.xxhash64("bid"), "bid")
    b = bloques.where(f"length(texto_plano) between 61 and {MAX_LARGO}").select(F.col("id").alias("bid"), "documento_id", "texto_plano")
    # the sampled documents are at most about 5 * max_docs; the window keeps max_bloques rows of each before and after its shuffle
    filas = b.join(F.broadcast(d), b.documento_id == d.id).withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_bloques).select("bid", "k", "texto_plano").collect()
    return [(w, IDIOMAS.index(f.k)) for f in sorted(filas) for w, frase in frases(f.texto_plano) if frase]


def tramos(mar: np.ndarray, fr: list[tuple[int, bool]], umbral: float) -> list[tuple[int, int, float, bool]]:
    """``(label, words, summed marginal, passage)`` of a block's runs in one language, from the marginals of its words.

    Words have the label with the largest marginal.  A sentence has the label with the
    largest sum over its words; shorter strays within it take that label, runs of
    ``MIN_INSERTO`` words or more in another language, at least as sure as ``umbral``, are
    runs of their own.  Consecutive sentences of one label are a passage if they hold
    ``MIN_PALABRAS`` words in sentences of running text and are sure on average.
    """
    et = mar.argmax(1)
    frases_: list[list] = []  # label, from, to, words of running text
    p = 0
    for cuantas, ok in fr:
        k = int(mar[p : p + cuantas].sum(0).argmax())
        if frases_ and frases_[-1][0] == k:
            frases_[-1][2] = p + cuantas
            frases_[-1][3] += cuantas * ok
        else:
            frases_.append([k, p, p + cuantas, cuantas * ok])
        p += cuantas
    salida: list[list] = []
    for k, a, b, buenas in frases_:
        pasa = k != NINGUNO and buenas >= MIN_PALABRAS and float(mar[a:b, k].mean()) >= umbral
        piezas = [(k, a, b)]
        if (et[a:b] != k).sum() >= MIN_INSERTO:
            cortes = [a, *(np.flatnonzero(np.diff(et[a:b])) + a + 1).tolist(), b]
            piezas = []
            for i, j in zip(cortes, cortes[1:]):
                q = int(et[i])
                if q != k and (j - i < MIN_INSERTO or float(mar[i:j, q].mean()) < umbral):
                    q = k
                if piezas and piezas[-1][0] == q:
                    piezas[-1] = (q, piezas[-1][1], j)
                else:
                    piezas.append((q, i, j))
        for q, i, j in piezas:
            x = (q, j - i, float(mar[i:j, q].sum()), pasa and q == k)
            if salida and salida[-1][0] == q:
                y = salida[-1]
                salida[-1] = (q, y[1] + x[1], y[2] + x[2], y[3] or x[3])
            else:
                salida.append(x)
    return salida


def segmentos(bloques: DataFrame, crf: Crf) -> DataFrame:
    """``(documento_id, bloque_id, n, idioma, palabras, confianza, pasaje)``, one row per run of words in one language.

    Words are labelled by their marginals (forward-backward over the whole block), see
    ``tramos``; ``confianza`` is the mean marginal of the run.  ``idioma`` is null for a run
    in no language.  ``pasaje``: the run belongs to sentences of running text in its language
    with at least 12 words.  Blocks without words and null texts give no row.  No shuffle;
    the field (fixed size) is broadcast; each distinct word of a task is scored once.
    """
    br = Difundido(bloques.sparkSession, crf)

    def tarea(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = br.valor
        voc: dict[str, int] = {}
        emi = np.zeros((0, NINGUNO + 1), np.float32)
        for lote in lotes:
            for desde in range(0, lote.num_rows, 2500):
                parte = lote.slice(desde, 2500)
                if len(voc) > 400_000:
                    voc, emi = {}, emi[:0]
                sec: list[list[int]] = []
                mapa: list[tuple[int, list[tuple[int, bool]]]] = []
                for n, t in enumerate(parte.column(2).to_pylist()):
                    if not t:
                        continue
                    fr = frases(t)
                    if fr:
                        sec.append([voc.setdefault(x, len(voc)) for w, _ in fr for x in w])
                        mapa.append((n, [(len(w), ok) for w, ok in fr]))
                if len(voc) > len(emi):
                    emi = np.concatenate([emi, np.array([crf.emision(x) for x in list(voc)[len(emi) :]], np.float32)])
                filas, idi, pal, conf, orden, pasa = [], [], [], [], [], []
                por_largo = sorted(range(len(sec)), key=lambda i: len(sec[i]))
                i = 0
                while i < len(por_largo):
                    largo = len(sec[por_largo[i]])
                    j = i
                    while j < len(por_largo) and len(sec[por_largo[j]]) <= max(16, largo * 5 // 4) and j - i < 2048:
                        j += 1
                    grupo = por_largo[i:j]
                    i = j
                    largos = np.array([len(sec[g]) for g in grupo])
                    t = int(largos.max())
                    vale = np.arange(t) < largos[:, None]
                    idx = np.zeros((len(grupo), t), np.int64)
                    idx[vale] = np.concatenate([sec[g] for g in grupo])
                    mar = crf.solo_marginales(emi[idx], vale)
                    # most blocks are in one language throughout
                    et = np.where(vale, mar.argmax(2), mar[:, :1].argmax(2))
                    pura = (et == et[:, :1]).all(1)
                    for f, g in enumerate(grupo):
                        n, fr = mapa[g]
                        if pura[f] and et[f, 0] != NINGUNO:
                            k, cuantas = int(et[f, 0]), len(sec[g])
                            s = float(mar[f, :cuantas, k].sum())
                            tr = [(k, cuantas, s, sum(c * ok for c, ok in fr) >= MIN_PALABRAS and s / cuantas >= crf.umbral)]
                        else:
                            tr = tramos(mar[f, : len(sec[g])], fr, crf.umbral)
                        for q, (k, cuantas, s, p) in enumerate(tr):
                            filas.append(n)
                            orden.append(q)
                            idi.append(IDIOMAS[k] if k != NINGUNO else None)
                            pal.append(cuantas)
                            conf.append(s / cuantas)
                            pasa.append(p)
                if filas:
                    q = pa.array(filas, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [parte.column(0).take(q), parte.column(1).take(q), pa.array(orden, pa.int32()), pa.array(idi, pa.string()), pa.array(pal, pa.int32()), pa.array(conf, pa.float64()), pa.array(pasa, pa.bool_())],
                        names=["documento_id", "bloque_id", "n", "idioma", "palabras", "confianza", "pasaje"],
                    )

    return bloques.select("documento_id", F.col("id").alias("bloque_id"), "texto_plano").mapInArrow(
        tarea, "documento_id string, bloque_id string, n int, idioma string, palabras int, confianza double, pasaje boolean"
    )


_AJUSTADOS: dict[int, Crf] = {}  # the last fit, by its sample


def _modelo(documentos: DataFrame, bloques: DataFrame) -> Crf:
    m = muestra(documentos, bloques)
    clave = zlib.crc32(repr(m).encode("utf-8", "replace"))
    if clave not in _AJUSTADOS:
        _AJUSTADOS.clear()
        _AJUSTADOS[clave] = entrenar(m)
    return _AJUSTADOS[clave]


def idiomas_no_nombrados(documentos: DataFrame, bloques: DataFrame) -> DataFrame:
    """``(documento_id, idioma)``: a block of the document holds a passage in a language its label does not name."""
    s = segmentos(bloques, _modelo(documentos, bloques)).where("pasaje").select("documento_id", "idioma").distinct()
    d = documentos.where("id is not null").select(F.col("id").alias("documento_id"), F.explode_outer(nombrados("idioma_original")).alias("idioma"))
    return s.join(d.select("documento_id"), "documento_id", "left_semi").join(d.where("idioma is not null"), ["documento_id", "idioma"], "left_anti")


def pasajes(documentos: DataFrame, bloques: DataFrame) -> DataFrame:
    """Every segment with its language and confidence; blocks delivered twice count once."""
    return segmentos(bloques, _modelo(documentos, bloques)).distinct()


def idioma_de_documentos(documentos: DataFrame, bloques: DataFrame) -> DataFrame:
    """``(documento_id, idioma, confianza, proporcion)``: language with the most words over the distinct blocks.

    ``confianza`` is the mean marginal of its words, ``proporcion`` its share of all words.
    A document without words of any language has null in ``idioma`` and ``confianza``.
    """
    s = pasajes(documentos, bloques).groupBy("documento_id", "idioma").agg(F.sum("palabras").alias("p"), F.sum(F.col("confianza") * F.col("palabras")).alias("c"))
    m = s.groupBy("documento_id").agg(F.sum("p").alias("total"), F.max(F.when(F.col("idioma").isNotNull(), F.struct("p", "idioma", "c"))).alias("x"))
    m = m.select("documento_id", "x.idioma", (F.col("x.c") / F.col("x.p")).alias("confianza"), (F.col("x.p") / F.col("total")).alias("proporcion"))
    return documentos.where("id is not null").select(F.col("id").alias("documento_id")).distinct().join(m, "documento_id", "left")
