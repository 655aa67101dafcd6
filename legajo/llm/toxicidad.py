"""Abusive, hateful or sexual content: a bidirectional gated recurrent network in numpy."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.llm.comun import Difundido, fijar, forma_unica

VENTANA, PASO = 24, 12
H, DW, DC, DA = 12, 10, 14, 8
CUBOS_W, CUBOS_C = 1 << 15, 1 << 13
MAX_ENTRENAMIENTO = 6000
MAX_FONDO = 2000
MAX_LARGO = 100_000  # characters of a document of the training sample; longer ones are scored like any other
LOTE = 128
UMBRAL_PREVIO = 0.8
_AJUSTADAS: dict[int, Red] = {}  # the last fit, by its sample
TIPICO = 2.0  # log ratio of document frequencies from which a trigram is typical of positive documents
_TROZO = re.compile(r"[^\W_]+(?:[@#$*0-9!']+[^\W_]+)*")
# --- fixed values: digits and signs that stand for letters ---------------------------------
_CIFRADO = str.maketrans("01345@$7!", "oieasasti")
# --- end of fixed values -------------------------------------------------------------------
_CIFRAS = re.compile(r"\d+")
_REPETIDA = re.compile(r"(\w)\1{2,}")


def normalizar_trozo(t: str) -> list[str]:
    """Words of a white-space separated piece: one form, masks undone, numbers as one word."""
    salida = []
    hallados = _TROZO.findall(forma_unica(t))
    if len(hallados) > 2 and all(len(w) == 1 for w in hallados):  # a word with signs between its letters
        hallados = ["".join(hallados)]
    for w in hallados:
        if w.isdigit():
            w = "0"
        elif not w.isalpha():
            # "m13rd4" masks a word, "18x" is a number beside a variable
            w = w.translate(_CIFRADO) if sum(map(str.isalpha, w)) >= 2 else _CIFRAS.sub("0", w)
        salida.append(_REPETIDA.sub(r"\1", w))
    return salida


def rasgos(w: str) -> tuple[int, list[int]]:
    """Word bucket and character-trigram buckets."""
    p = f"^{w}$"
    return zlib.crc32(w.encode("utf-8", "replace")) % CUBOS_W, [zlib.crc32(p[i : i + 3].encode("utf-8", "replace")) % CUBOS_C for i in range(max(1, len(p) - 2))]


class Lexico:
    """Word ↔ row; grows as words are met.  A piece of text is normalised once."""

    def __init__(self):
        self.de: dict[str, int] = {}
        self.trozos: dict[str, list[int]] = {}
        self.palabras: list[str] = []

    def codigos(self, texto: str) -> list[int]:
        salida: list[int] = []
        trozos = self.trozos
        for t in texto.split():
            c = trozos.get(t)
            if c is None:
                c = []
                for w in normalizar_trozo(t):
                    n = self.de.get(w)
                    if n is None:
                        n = self.de[w] = len(self.palabras)
                        self.palabras.append(w)
                    c.append(n)
                trozos[t] = c
            salida += c
        return salida


def ventanas(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words; every run of up to VENTANA - PASO words lies whole in one."""
    if n <= VENTANA:
        return [(0, n)] if n else []
    return [(i, i + VENTANA) for i in range(0, n - VENTANA, PASO)] + [(n - VENTANA, n)]


def _sigma(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Red:
    """Embedding of word and characters → two gated recurrent passes → attention pooling → probability."""

    def __init__(self, semilla: int = 5):
        g = np.random.default_rng(semilla)
        r = lambda *s, e: (g.standard_normal(s) * e).astype(np.float32)
        d = DW + DC
        self.p = {
            "ew": r(CUBOS_W, DW, e=0.1), "ec": r(CUBOS_C, DC, e=0.3),
            "wf": r(d, 3 * H, e=d**-0.5), "wb": r(d, 3 * H, e=d**-0.5), "bf": np.zeros(3 * H, np.float32), "bb": np.zeros(3 * H, np.float32),
            "uf": r(H, 3 * H, e=H**-0.5), "ub": r(H, 3 * H, e=H**-0.5),
            "a": r(2 * H, DA, e=(2 * H) ** -0.5), "v": r(DA, e=DA**-0.5), "o": r(2 * H, e=0.3), "c": np.full(1, -2, np.float32),
        }

    def entradas(self, palabras: list[str]) -> np.ndarray:
        x = np.empty((len(palabras), DW + DC), np.float32)
        ew, ec = self.p["ew"], self.p["ec"]
        for i, w in enumerate(palabras):
            b, t = rasgos(w)
            x[i, :DW] = ew[b]
            x[i, DW:] = ec[t].mean(0)
        return x

    def _pasada(self, a: np.ndarray, idx: np.ndarray, vale: np.ndarray | None, u: np.ndarray, orden, guardar: bool):
        """a: projected inputs by word; returns hidden states (T, n, H) and what the way back needs."""
        n, t = idx.shape
        h = np.zeros((n, H), np.float32)
        hs = np.empty((t, n, H), np.float32)
        memo = []
        for k in orden:
            x = a[idx[:, k]]
            hu = h @ u
            zr = x[:, : 2 * H] + hu[:, : 2 * H]
            np.negative(zr, out=zr)
            np.minimum(zr, 30, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[:, 2 * H :] + r * hu[:, 2 * H :])
            nueva = c + z * (h - c)
            if vale is not None:
                nueva = np.where(vale[:, k : k + 1], nueva, h)
            if guardar:
                memo.append((k, h, hu[:, 2 * H :], z, r, c))
            hs[k] = h = nueva
        return hs, memo

    def adelante(self, af, ab, idx, vale=None, guardar=False):
        t = idx.shape[1]
        hf, mf = self._pasada(af, idx, vale, self.p["uf"], range(t), guardar)
        hb, mb = self._pasada(ab, idx, vale, self.p["ub"], range(t - 1, -1, -1), guardar)
        h = np.concatenate([hf, hb], 2)
        g = np.tanh(h @ self.p["a"])
        s = g @ self.p["v"]
        if vale is not None:
            s = np.where(vale.T, s, -1e9)
        e = np.exp(s - s.max(0))
        al = e / e.sum(0)
        m = np.einsum("tn,tnh->nh", al, h)
        y = _sigma(m @ self.p["o"] + self.p["c"])
        return y, (h, g, al, m, mf, mb)

    def puntuar(self, x: np.ndarray, idx: np.ndarray, vale: np.ndarray | None = None, lote: int = 1024) -> np.ndarray:
        af, ab = x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]
        return np.concatenate([self.adelante(af, ab, idx[i : i + lote], None if vale is None else vale[i : i + lote])[0] for i in range(0, len(idx), lote)] or [np.zeros(0, np.float32)])

    def gradiente(self, x: np.ndarray, idx: np.ndarray, vale: np.ndarray, meta: np.ndarray, peso: np.ndarray):
        """Gradients of the weighted cross entropy; the one of x comes by word."""
        p = self.p
        af, ab = x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]
        y, (h, g, al, m, mf, mb) = self.adelante(af, ab, idx, vale, True)
        dy = ((y - meta) * peso / peso.sum()).astype(np.float32)
        gr = {"o": m.T @ dy, "c": dy.sum(keepdims=True)}
        dm = dy[:, None] * p["o"]
        dal = np.einsum("nh,tnh->tn", dm, h)
        ds = al * (dal - (al * dal).sum(0))
        dh = al[:, :, None] * dm
        gr["v"] = np.einsum("tn,tnd->d", ds, g)
        dg = ds[:, :, None] * p["v"] * (1 - g * g)
        gr["a"] = np.einsum("tnh,tnd->hd", h, dg)
        dh = dh + dg @ p["a"].T
        dx = np.zeros_like(x)
        orden = np.argsort(idx.T.ravel(), kind="stable")  # positions by word, for sums over the uses of a word
        cada, desde = np.unique(idx.T.ravel()[orden], return_index=True)
        for memo, u, w, b, parte in ((mf, "uf", "wf", "bf", dh[:, :, :H]), (mb, "ub", "wb", "bb", dh[:, :, H:])):
            gu = np.zeros_like(p[u])
            da_t = np.zeros((idx.shape[1], len(idx), 3 * H), np.float32)
            llega = np.zeros((len(idx), H), np.float32)
            for k, h0, hun, z, r, c in reversed(memo):
                d = parte[k] + llega
                v = vale[:, k : k + 1]
                dv = np.where(v, d, 0)
                dc = dv * (1 - z) * (1 - c * c)
                dz = dv * (h0 - c) * z * (1 - z)
                dr = dc * hun * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                gu += h0.T @ du
                da_t[k] = da
                llega = du @ p[u].T + np.where(v, dv * z, d)
            da_w = np.zeros((len(x), 3 * H), np.float32)
            da_w[cada] = np.add.reduceat(da_t.reshape(-1, 3 * H)[orden], desde, axis=0)
            gr[u], gr[w], gr[b] = gu, x.T @ da_w, da_w.sum(0)
            dx += da_w @ p[w].T
        return gr, dx


def _matriz(codigos: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, codigos))
    idx, vale = np.zeros((len(codigos), t), np.int64), np.zeros((len(codigos), t), bool)
    for i, c in enumerate(codigos):
        idx[i, : len(c)] = c
        vale[i, : len(c)] = True
    return idx, vale


def _ngramas(c: list[int]) -> set[int]:
    """Words and word trigrams of a code sequence, as integers."""
    return {x * 1_000_003 for x in c} | {hash((c[i], c[i + 1], c[i + 2])) for i in range(len(c) - 2)}


def entrenar(textos: list[str], metas: list[float], rondas: int = 4, pasos: int = 320, semilla: int = 11) -> Red:
    """Multiple-instance training: a label judges a document, the network scores windows.

    The first positive windows are those with the strongest evidence (words and word
    trigrams that positive documents hold far more often than the others).  Each round
    trains ``pasos`` batches, whatever the size of the sample: a quarter positive windows, a
    half the hardest windows of negative documents, a quarter random ones; then the windows
    are chosen again by the network's own scores.  Windows that contradict their label
    (wrong labels, remarks in unjudged documents) do not count: a positive document whose
    windows all score low, and a negative window that scores high **and** holds a trigram
    typical of positive documents.  A formula of courtesy scores high now and then, but
    stands in negative documents as well, so it stays a negative example.  Without both
    kinds of label the untrained network, whose scores stay low, is returned.
    """
    g = np.random.default_rng(semilla)
    red, lex = Red(), Lexico()
    docs = [lex.codigos(t) for t in textos]
    vent, dueno, inicio = [], [], []
    for n, c in enumerate(docs):
        for i, j in ventanas(len(c)):
            vent.append(c[i:j])
            dueno.append(n)
            inicio.append(i)
    y = np.array([float(m) for m in metas])
    if not vent or not (y > 0.5).any() or not (y < 0.5).any():
        return red
    dueno = np.array(dueno)
    V = len(lex.palabras)
    # evidence of a word or trigram: document frequencies in positive and negative documents
    pos, neg = (y > 0.5).sum(), (y <= 0.5).sum()
    en_pos, en_neg = Counter(), Counter()
    for c, m in zip(docs, y):
        (en_pos if m > 0.5 else en_neg).update(_ngramas(c))
    razon = {k: float(np.log((n + 0.2) / (pos + 0.4)) - np.log((en_neg.get(k, 0) + 0.2) / (neg + 0.4))) for k, n in en_pos.items() if n + en_neg.get(k, 0) >= 2 and en_neg.get(k, 0) <= 0.02 * neg}
    peso_w = np.zeros(V)
    for k in range(V):
        if (r := razon.get(k * 1_000_003, 0.0)) > 1:
            peso_w[k] = min(r, 4.0)
    prueba = lambda v: sum(sorted((peso_w[w] for w in set(v)), reverse=True)[:8])
    nota = np.array([prueba(v) for v in vent])
    tipico = lambda v: any(razon.get(hash((v[i], v[i + 1], v[i + 2])), 0.0) > TIPICO for i in range(len(v) - 2))

    def corridas(elegidas) -> list[list[int]]:
        """The chosen windows a few words to and fro, where they keep most of their evidence: a remark may stand anywhere in a window."""
        salida = []
        for k in elegidas:
            c, i, base = docs[dueno[k]], inicio[k], prueba(vent[k])
            for d in (-10, -7, -4, 4, 7, 10):
                v = c[i + d : i + d + VENTANA] if i + d >= 0 else []
                if base and len(v) == VENTANA and prueba(v) >= 0.7 * base:
                    salida.append(v)
        return salida

    idx, vale = _matriz(vent)
    filas = [rasgos(w) for w in lex.palabras]
    cubo_w = np.array([f[0] for f in filas])
    uso_w, inv_w = np.unique(cubo_w, return_inverse=True)
    tri_dueno = np.repeat(np.arange(V), [len(f[1]) for f in filas])
    tri_cubo = np.concatenate([f[1] for f in filas])
    uso_c, inv_c = np.unique(tri_cubo, return_inverse=True)
    n_tri = np.bincount(tri_dueno, minlength=V)[:, None].astype(np.float32)
    par = {k: v for k, v in red.p.items() if k not in ("ew", "ec")} | {"ew": red.p["ew"][uso_w], "ec": red.p["ec"][uso_c]}
    m1, m2, paso = {k: np.zeros_like(v) for k, v in par.items()}, {k: np.zeros_like(v) for k, v in par.items()}, 0
    inicio_tri = np.concatenate([[0], np.cumsum(n_tri[:, 0])[:-1]]).astype(np.int64)

    def entradas():
        ec = np.add.reduceat(par["ec"][inv_c], inicio_tri, axis=0) / n_tri
        return np.concatenate([par["ew"][inv_w], ec], 1)

    def mejores(valor, cuantas, donde):
        o = np.lexsort((-valor, dueno))
        rango = np.arange(len(o)) - np.searchsorted(dueno[o], dueno[o])
        return o[(rango < cuantas) & donde[o]]

    es_pos = (y > 0.5)[dueno]
    tope = np.zeros(len(docs))
    np.maximum.at(tope, dueno, nota)
    piso = 3.0 if ((y > 0.5) & (tope >= 3.0)).sum() >= 5 else 0.0
    vivo = es_pos & (tope >= piso)[dueno] | ~es_pos & (nota < 10.0)
    for ronda in range(rondas):
        pos_v = mejores(nota, 1, es_pos & vivo)
        dificil, otra = mejores(nota, 2, ~es_pos & vivo), np.flatnonzero(~es_pos & vivo)
        if not len(pos_v) or not len(otra):
            break
        extra = corridas(pos_v)
        if extra:
            ei, ev = _matriz(extra)
            t = idx.shape[1]
            ei, ev = np.pad(ei, ((0, 0), (0, t - ei.shape[1]))), np.pad(ev, ((0, 0), (0, t - ev.shape[1])))
            idx_t, vale_t = np.concatenate([idx, ei]), np.concatenate([vale, ev])
        else:
            idx_t, vale_t = idx, vale
        pos_t = np.concatenate([pos_v, np.arange(len(idx), len(idx_t))])
        meta = np.repeat(np.array([0.97, 0.01], np.float32), [LOTE // 4, LOTE - LOTE // 4])
        for _ in range(pasos):
            s = np.concatenate([g.choice(pos_t, LOTE // 4), g.choice(dificil, LOTE // 2), g.choice(otra, LOTE // 4)])
            usadas, local = np.unique(idx_t[s], return_inverse=True)
            # inputs of the words of this batch only
            visible = (g.random((len(usadas), 1)) > 0.2).astype(np.float32)  # words unseen now and then: the characters must do
            tri = np.concatenate([np.arange(inicio_tri[w], inicio_tri[w] + int(n_tri[w, 0])) for w in usadas])
            ini = np.concatenate([[0], np.cumsum(n_tri[usadas, 0])[:-1]]).astype(np.int64)
            x_todo = np.concatenate([par["ew"][inv_w[usadas]] * visible, np.add.reduceat(par["ec"][inv_c[tri]], ini, axis=0) / n_tri[usadas]], 1)
            gr, dx = red.gradiente(x_todo, local.reshape(idx_t[s].shape), vale_t[s], meta, np.ones(LOTE, np.float32))
            gw, gc = np.zeros_like(par["ew"]), np.zeros_like(par["ec"])
            np.add.at(gw, inv_w[usadas], dx[:, :DW] * visible)
            np.add.at(gc, inv_c[tri], np.repeat(dx[:, DW:] / n_tri[usadas], n_tri[usadas, 0].astype(int), axis=0))
            gr["ew"], gr["ec"] = gw, gc
            paso += 1
            for k, d in gr.items():
                d = np.clip(d, -1, 1) + 1e-5 * par[k]
                m1[k] += 0.1 * (d - m1[k])
                m2[k] += 0.002 * (d * d - m2[k])
                par[k] -= (0.006 * (m1[k] / (1 - 0.9**paso)) / (np.sqrt(m2[k] / (1 - 0.998**paso)) + 1e-6)).astype(np.float32)
                if k in red.p and k not in ("ew", "ec"):
                    red.p[k] = par[k]
        nota = red.puntuar(entradas(), idx, vale)
        tope = np.zeros(len(docs))
        np.maximum.at(tope, dueno, nota)
        alta = ~es_pos & (nota >= 0.5)
        alta[alta] = [tipico(vent[k]) for k in np.flatnonzero(alta)]
        vivo = es_pos & (tope > 0.3)[dueno] | ~es_pos & ~alta
    red.p["ew"][uso_w], red.p["ec"][uso_c] = par["ew"], par["ec"]
    return red


def juicios(etiquetas: DataFrame) -> DataFrame:
    """``(doc_id, meta)``: mean judgement of each judged document; null judgements do not count, ties between annotators are left out."""
    return etiquetas.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("meta")).where("meta <> 0.5")


def en_muestra(n: int, maximo: int = MAX_ENTRENAMIENTO) -> Column:
    """Does a document, one of ``n`` judged ones, belong to the sample for training?"""
    return F.lit(True) if n <= maximo else F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1e6 * maximo / n)


def muestra_etiquetada(documentos: DataFrame, etiquetas: DataFrame, maximo: int = MAX_ENTRENAMIENTO, fondo: int = MAX_FONDO) -> tuple[list[str], list[float], list[bool]]:
    """Texts, mean judgement, and whether judged, of at most about ``maximo`` judged documents, chosen by a hash of the id.

    Null judgements, null texts and texts beyond ``MAX_LARGO`` characters do not count, ties
    between annotators are left out.  About
    ``fondo`` documents without a judgement come along with the judgement 0, as many from
    each language and source (256 strata by hash), so that the formulas of a small forum
    are known as well as those of a large one.
    """
    e = juicios(etiquetas)
    e = e.where(en_muestra(e.count(), maximo))
    # the sample has a stated bound, so its ids may be broadcast
    corto = documentos.where(F.length("text") <= MAX_LARGO)
    d = corto.select("doc_id", "text")
    filas = [(f.text, f.meta, True) for f in sorted(d.join(F.broadcast(e), "doc_id").distinct().collect())]
    if not filas:
        return [], [], []
    estrato = F.pmod(F.xxhash64(*[c for c in ("lang", "source") if c in documentos.columns], F.lit(6)), F.lit(256)).alias("estrato")
    x = corto.select("doc_id", "text", estrato)
    cuentas = {r.estrato: r["count"] for r in x.groupBy("estrato").count().collect()}  # at most 256 rows
    parte = F.element_at(F.create_map(*[F.lit(v) for k, c in cuentas.items() for v in (k, min(1.0, fondo / len(cuentas) / c))]), F.col("estrato"))
    x = x.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < 1e6 * parte)
    filas += [(f.text, 0.0, False) for f in sorted(x.join(F.broadcast(e.select("doc_id")), "doc_id", "left_anti").select("doc_id", "text").distinct().collect())]
    return [f[0] for f in filas], [f[1] for f in filas], [f[2] for f in filas]


REJILLA = [round(0.3 + 0.05 * k, 2) for k in range(14)]  # thresholds to choose from


def mejor_umbral(bien: list[int], altos: list[int], positivos: int, previo: float = UMBRAL_PREVIO) -> float:
    """The threshold of ``REJILLA`` with the best harmonic mean, from the true and all documents at or above each; on ties the one nearest ``previo``."""
    f = [2 * b / max(1, a + positivos) for b, a in zip(bien, altos)]
    mejor, elegido = -1.0, previo
    for k in sorted(range(len(REJILLA)), key=lambda k: abs(REJILLA[k] - previo)):
        if f[k] > mejor + 1e-9:
            mejor, elegido = f[k], REJILLA[k]
    return elegido


def elegir_umbral(puntos: np.ndarray, metas: np.ndarray, previo: float = UMBRAL_PREVIO) -> float:
    """``mejor_umbral`` of scores and judgements in arrays."""
    return mejor_umbral([int(((puntos >= u) & (metas > 0.5)).sum()) for u in REJILLA], [int((puntos >= u).sum()) for u in REJILLA], int((metas > 0.5).sum()), previo)


def apartado() -> Column:
    """One document in five, by a hash of its text, is never trained on while it is judged; nor is one too long for the sample."""
    return (F.crc32("text") % 5 == 0) | (F.length("text") > MAX_LARGO)


def umbral_de(puntuados: DataFrame, etiquetas: DataFrame, maximo: int = MAX_ENTRENAMIENTO) -> float:
    """Threshold from all judged documents that were not trained on: counts over ``puntuados(doc_id, puntaje, apartado)``.

    Scores and judgements meet in a join of ids, no text moves; 29 counts come to the driver.
    """
    e = juicios(etiquetas)
    j = puntuados.where("apartado is not null").select("doc_id", "puntaje", "apartado").distinct().join(e.withColumn("_m", en_muestra(e.count(), maximo)), "doc_id").where("apartado or not _m")
    si = F.col("meta") > 0.5
    c = j.agg(F.count_if(si), *[F.count_if((F.col("puntaje") >= u) & si) for u in REJILLA], *[F.count_if(F.col("puntaje") >= u) for u in REJILLA]).first()
    return mejor_umbral(list(c[1 : 1 + len(REJILLA)]), list(c[1 + len(REJILLA) :]), c[0])


def ajustar(textos: list[str], metas: list[float], juzgado: list[bool]) -> Red:
    """The network of a sample; its judged documents that ``apartado`` names are held out."""
    clave = zlib.crc32(repr((textos, metas)).encode("utf-8", "replace"))
    if clave not in _AJUSTADAS:
        dentro = [not (j and zlib.crc32(t.encode("utf-8", "replace")) % 5 == 0) for t, j in zip(textos, juzgado)]
        red = entrenar([t for t, d in zip(textos, dentro) if d], [m for m, d in zip(metas, dentro) if d])
        _AJUSTADAS.clear()
        _AJUSTADAS[clave] = red
    return _AJUSTADAS[clave]


def puntuar(documentos: DataFrame, red: Red, *otras: str) -> DataFrame:
    """``(doc_id, puntaje, ventanas, *otras)``: highest score over all overlapping windows of each document.

    Null, empty and blank texts have score 0 and no windows.  Repeated rows give repeated
    rows.  No shuffle; the network (a few MB, fixed size) is broadcast.
    """
    b = Difundido(documentos.sparkSession, red)

    def tarea(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        red = b.valor
        lex = Lexico()
        af = ab = np.zeros((0, 3 * H), np.float32)
        for lote in lotes:
            for desde in range(0, lote.num_rows, 500):
                parte = lote.slice(desde, 500)
                if len(lex.trozos) > 400_000:
                    lex, af, ab = Lexico(), af[:0], ab[:0]
                todos: list[int] = []
                ini: list[int] = []
                dueno: list[int] = []
                cortos: list[tuple[int, list[int]]] = []
                for n, t in enumerate(parte.column(1).to_pylist()):
                    c = lex.codigos(t) if t else []
                    if len(c) <= VENTANA:
                        if c:
                            cortos.append((n, c))
                        continue
                    base = len(todos)
                    todos += c
                    v = ventanas(len(c))
                    ini += [base + i for i, _ in v]
                    dueno += [n] * len(v)
                if len(lex.palabras) > len(af):
                    x = red.entradas(lex.palabras[len(af) :])
                    af = np.concatenate([af, x @ red.p["wf"] + red.p["bf"]])
                    ab = np.concatenate([ab, x @ red.p["wb"] + red.p["bb"]])
                nota = np.zeros(parte.num_rows, np.float32)
                cuantas = np.zeros(parte.num_rows, np.int32)
                x = np.array(todos, np.int64)
                for i in range(0, len(ini), 1024):
                    s, d = np.array(ini[i : i + 1024]), np.array(dueno[i : i + 1024])
                    y, _ = red.adelante(af, ab, x[s[:, None] + np.arange(VENTANA)])
                    np.maximum.at(nota, d, y)
                    np.add.at(cuantas, d, 1)
                if cortos:
                    idx, vale = _matriz([c for _, c in cortos])
                    y, _ = red.adelante(af, ab, idx, vale)
                    d = np.array([n for n, _ in cortos])
                    nota[d], cuantas[d] = y, 1
                yield pa.RecordBatch.from_arrays([parte.column(0), pa.array(nota.astype(np.float64)), pa.array(cuantas), *parte.columns[2:]], names=["doc_id", "puntaje", "ventanas", *otras])

    e = documentos.select("doc_id", "text", *otras)
    return e.mapInArrow(tarea, T.StructType([e.schema[0], *T.StructType.fromDDL("puntaje double, ventanas int").fields, *e.schema.fields[2:]]))


def con_umbral(documentos: DataFrame, etiquetas: DataFrame, *otras: str) -> tuple[DataFrame, float]:
    """Every document scored once, ``(doc_id, puntaje, ventanas, *otras)``, and the threshold; the scores, which hold no text, are kept for both."""
    red = ajustar(*muestra_etiquetada(documentos, etiquetas))
    p = fijar(puntuar(documentos.withColumn("apartado", apartado()), red, "apartado", *otras))
    return p.drop("apartado"), umbral_de(p, etiquetas)


def puntajes(documentos: DataFrame, etiquetas: DataFrame) -> DataFrame:
    """``(doc_id, puntaje, ventanas, toxico)`` with a network trained on a bounded sample of the judgements; ``toxico``: the score reaches the threshold set by all judged documents outside it."""
    p, umbral = con_umbral(documentos, etiquetas)
    return p.withColumn("toxico", F.col("puntaje") >= umbral)


def hallados(documentos: DataFrame, etiquetas: DataFrame) -> DataFrame:
    """``(doc_id)`` of the documents that reach the threshold, each once."""
    return puntajes(documentos, etiquetas).where("toxico").select("doc_id").distinct()


def tasas(documentos: DataFrame, etiquetas: DataFrame) -> DataFrame:
    """``(source, n_docs, n_toxicos, tasa)`` per source; null is a source, a repeated document counts once."""
    # the source travels with the text, so nothing is joined
    p, umbral = con_umbral(documentos, etiquetas, "source")
    p = p.groupBy("source", "doc_id").agg(F.max("puntaje").alias("puntaje"))
    return (
        p.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("puntaje") >= umbral).alias("n_toxicos"))
        .withColumn("tasa", F.col("n_toxicos") / F.col("n_docs"))
    )
