"""Training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import random
import sys
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from legajo.llm import calidad, comun, consultas, corte, escaneo, forma, fuga, idioma, tokens, toxicidad, truncado

SF = "/root/testdata/sf0.001"


def tabla(spark, n):
    return spark.read.parquet(f"{SF}/{n}.parquet")


# ---- 7: tokens -------------------------------------------------------------------------------
def test_trie_equals_merges_by_rank():
    r = tokens.leer_rangos(consultas.VOCABULARIO)
    trie = tokens.TrieBpe(r)
    g = random.Random(3)
    ws = {bytes(g.choice(b"abcetionsr XYZ.,-=_") for _ in range(g.randint(1, 30))) for _ in range(2000)} | {("ñandú " * 5).encode(), b"\xf0\x9f\x98\x80"}
    got = trie.codificar(ws)
    assert all(got[w] == trie.fusionar(w) for w in ws)


def test_tokens_edges_and_round_trip(spark):
    filas = [(1, None), (2, ""), (3, " \t "), (4, "fin <|endoftext|> fin"), (5, "a" * 20_000), (6, "Hola, ¿qué tal? 123"), (6, "Hola, ¿qué tal? 123")]
    df = spark.createDataFrame(filas, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as `raro.col`")
    r = [(x.doc_id, list(x.ids)) for x in tokens.codificar_corpus(df, consultas.VOCABULARIO).collect()]
    assert len(r) == 7 and dict(r)[1] == [] and dict(r)[2] == []
    inv = {v: k for k, v in tokens.leer_rangos(consultas.VOCABULARIO).items()}
    textos = dict(filas)
    assert all(b"".join(inv[i] for i in ids).decode() == (textos[d] or "") for d, ids in r)
    assert tokens.codificar_corpus(df.limit(0), consultas.VOCABULARIO).count() == 0


# ---- 2: cutoffs --------------------------------------------------------------------------------
@pytest.mark.parametrize("max_orden", [10, 100_000])
def test_cutoff_is_exact(spark, max_orden):
    g = np.random.default_rng(1)
    pdf = pd.DataFrame({"fuente": g.choice(["a", "b", "c"], 3000, p=[0.8, 0.15, 0.05]), "puntaje": np.round(g.random(3000), 2)})
    pdf.loc[pdf.fuente == "c", "puntaje"] = 0.5
    pdf.loc[0, "puntaje"] = np.nan
    obj = spark.createDataFrame([("a", 0.75), ("b", 0.5), ("c", 0.3), ("sin", 0.5), (None, 0.1), ("a", None)], "fuente string, fraccion double")
    got = {r.fuente: r for r in corte.cortes(spark.createDataFrame(pdf), obj, max_orden).collect()}
    assert set(got) == {"a", "b", "c"}
    for f, frac in (("a", 0.75), ("b", 0.5), ("c", 0.3)):
        s = pdf[pdf.fuente == f].puntaje.dropna()
        esperado = max(c for c in s.unique() if (s >= c).sum() >= frac * len(s))
        assert got[f].corte == esperado and got[f].n_conservados == (s >= esperado).sum() and got[f].n_total == len(s)


def test_cutoff_empty(spark):
    o, b, u = tabla(spark, "ocr_resultados"), tabla(spark, "bloques"), tabla(spark, "umbrales")
    assert corte.conservados(o.limit(0), b, u).count() == 0
    assert corte.conservados(o, b, u.limit(0)).count() == 0


# ---- 3: look-alikes ------------------------------------------------------------------------------
def test_visual_and_comparison_forms():
    assert comun.visual("ｃａｆé​ а") == "café a"
    assert comun.visual("x y") == "x y" and comun.visual("x  y") != comun.visual("x y")
    for a, b in [("x²", "x2"), ("ℝ", "R"), ("Casa", "casa"), ("año", "ano"), ("a\nb", "a b")]:
        assert comun.visual(a) != comun.visual(b)
    assert comun.forma_unica("ＳＴＲＡẞＥ  x²") == "strasse x2"
    g = random.Random(2)
    alfabeto = [chr(g.choice([g.randint(32, 126), g.randint(160, 600), g.randint(0x300, 0x460), g.randint(0x2000, 0x2130), g.randint(0xFF01, 0xFF5E)])) for _ in range(500)]
    for _ in range(2000):
        s = "".join(g.choice(alfabeto) for _ in range(5))
        assert comun.visual(comun.visual(s)) == comun.visual(s)


def test_pairs_that_look_the_same(spark):
    filas = [("1", "casa", None), ("2", "cаsa", ""), ("2", "cаsa", ""), ("3", "casa", "x"), ("4", "Casa", "ｘ"), ("5", None, "x​"), ("6", "c​asa", "x"), (None, "casa", "x")]
    df = spark.createDataFrame(filas, "id string, texto_plano string, latex string")
    got = {tuple(r) for r in forma.pares_iguales_a_la_vista(df).collect()}
    esperado = set()
    f = {(i, c, v) for i, a, b in filas if i for c, v in (("texto_plano", a), ("latex", b)) if v is not None}
    for i, c, v in f:
        for j, d, w in f:
            if i < j and c == d and v != w and comun.visual(v) == comun.visual(w):
                esperado.add((i, j, c))
    assert got == esperado and len(got) == 10
    assert forma.pares_iguales_a_la_vista(df.limit(0)).count() == 0
    n = {(r.bloque_id, r.campo): r.enlaces for r in forma.enlaces(df).collect()}
    assert all(n[(b, c)] == sum(1 for p in esperado if p[2] == c and b in p[:2]) for b, c in n) and {(x, p[2]) for p in esperado for x in p[:2]} == set(n)


# ---- 8: leaks -------------------------------------------------------------------------------------
def test_leaks_against_brute_force(spark):
    docs, items = tabla(spark, "documents"), tabla(spark, "benchmark")
    got = {(r.doc_id, r.item_id) for r in fuga.fugas(docs, items).where("distancia = 0").collect()}
    ventanas = {}
    for r in items.collect():
        for u in (True, False):
            w = fuga.palabras(r.text, u)
            for i in range(len(w) - 9):
                ventanas.setdefault(tuple(w[i : i + 10]), set()).add(r.item_id)
    esperado = set()
    for r in docs.where("text is not null").collect():
        for u in (True, False):
            w = fuga.palabras(r.text, u)
            for i in range(len(w) - 9):
                esperado |= {(r.doc_id, k) for k in ventanas.get(tuple(w[i : i + 10]), ())}
    assert got == esperado and esperado


@pytest.mark.parametrize("ediciones", [1, 2])
@pytest.mark.parametrize("cambio", ["quita", "pone", "cambia"])
def test_leak_recall_by_kind_of_edit(spark, ediciones, cambio):
    g = random.Random(ediciones)
    vocab = [f"palabra{chr(97 + i % 26)}{i}" for i in range(300)]
    base = [[g.choice(vocab) for _ in range(10)] for _ in range(120)]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(base)], "item_id long, text string")
    docs = []
    for i, w in enumerate(base):
        v = list(w)
        for _ in range(ediciones):
            k = g.randrange(1, len(v) - 1)
            v[k : k + (cambio != "pone")] = [] if cambio == "quita" else [g.choice(vocab)]
        docs.append((i, " ".join([g.choice(vocab) for _ in range(6)] + v + [g.choice(vocab) for _ in range(6)])))
    # a window has as many words as the item, so a word taken out or put in moves one at the edge too
    d = ediciones if cambio == "cambia" else 2 * ediciones
    f = fuga.fugas(spark.createDataFrame(docs, "doc_id long, text string"), items, ediciones=d, repeticiones=6 if d == 1 else 12, muestra=6 if d == 1 else 3)
    assert len({r.doc_id for r in f.collect() if r.doc_id == r.item_id}) >= 0.9 * len(base)


def test_leak_forms_and_recall_at_distance_one(spark):
    g = random.Random(1)
    vocab = [f"palabra{chr(97 + i % 26)}{i}" for i in range(400)]
    base = [[g.choice(vocab) for _ in range(10)] for _ in range(150)]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(base)] + [(999, None), (998, "corto"), (0, " ".join(base[0]))], "item_id long, text string")
    docs = []
    for i, w in enumerate(base):
        v = list(w)
        v[g.randint(0, 9)] = "otra"
        docs.append((i, " ".join(v)))
    docs += [(5000, "**" + " ".join(base[3]).upper().replace("PALABRA", "PALA-\nBRA", 1) + "**"), (5001, None), (5002, "")]
    f = fuga.fugas(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert ("5000", 3, 0) in {(str(r.doc_id), r.item_id, r.distancia) for r in f}
    hallados = {r.doc_id for r in f if r.distancia == 1 and r.doc_id == r.item_id}
    assert len(hallados) >= 0.9 * len(base)
    assert fuga.fugas(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0


# ---- 1: language ------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "etiqueta,esperado",
    [("es_ES", ["es"]), ("ESPAÑOL ", ["es"]), ("Englisch", ["en"]), ("en-DE", ["en"]), ("fr-CA", ["fr"]), ("ru", []), ("", []), (None, []), ("??", []), ("ｐｔ", ["pt"]), ("inglés/alemán", ["de", "en"])],
)
def test_label_names(etiqueta, esperado):
    assert idioma.idiomas_nombrados(etiqueta) == esperado


@pytest.mark.parametrize(
    "linea",
    [
        "La condición vale siempre que |s - 21| < d en todo el intervalo. The condition holds whenever |s - 38| < d on the whole interval.",
        "Sea P(A | B) menor que P(A | C) en todo el espacio de pruebas considerado aquí. The bound P(C | B) holds for every set of the family.",
        "Uno es abierto; otro es cerrado; otro es compacto; y el último es denso en todo el espacio de las funciones. The last one is dense in the whole space.",
        "- La condición vale siempre en todo el intervalo de la variable. The condition holds on the whole interval.",
    ],
)
def test_lines_of_prose_are_no_rows(linea):
    f = idioma.frases(linea)
    assert len(f) == 2 and all(ok for _, ok in f) and f[1][0][0] == "the"
    assert idioma._es_fila(linea) is False


@pytest.mark.parametrize("linea", ["| a | 3.5 | uno |", "|a |b |c |", "|a|b|c|", "a|b|c|d", "vector & 3.1 & 4 \\\\", "norma;1.5;2;3", "norma\t1.5\t2", "| " + "una celda muy larga con un texto que sigue y sigue hasta pasar de doce | " * 3])
def test_rows_stay_rows(linea):
    assert idioma._es_fila(linea)


def test_field_on_held_out_sentences(spark):
    D, B = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documentos.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/bloques.parquet")
    ej = idioma.muestra(D, B)
    g = random.Random(1)
    g.shuffle(ej)
    corte_ = len(ej) * 4 // 5
    crf = idioma.entrenar(ej[:corte_])
    bien = [int(sum(crf.emision(w) for w in ws).argmax()) == k for ws, k in ej[corte_:] if len(ws) >= 12]
    assert len(bien) > 50 and np.mean(bien) > 0.85  # a part of the labels is wrong
    mezcla = "El resultado anterior no es válido cuando la función deja de ser uniforme en todos los casos. We consider the open set and check that it holds for every sufficiently large index of the sequence."
    df = spark.createDataFrame([("d", "b", mezcla), ("d", "c", None), ("d", "e", ""), ("d", "f", "• anillo lineal\n• grupo abierto")], "documento_id string, id string, texto_plano string")
    r = {(x.bloque_id, x.idioma) for x in idioma.segmentos(df, crf).where("pasaje").collect()}
    assert r == {("b", "es"), ("b", "en")}
    assert idioma.idiomas_no_nombrados(D.limit(0), B).count() == 0
    assert idioma.idioma_de_documentos(D, B.limit(0)).where("idioma is not null").count() == 0


def test_segments_cut_within_sentences_and_text_in_no_language(spark):
    D, B = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documentos.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/bloques.parquet")
    crf = idioma.entrenar(idioma.muestra(D, B))
    nada = ["test " * 60, "qx zvk bnm kjh trw pqs vbn " * 6, "Ã©ž™ªð™Âž ðœžÃ©¢ª ±Ã©¢ž œÃžŸ ðžÃÂ " * 8, "zCq4rEq1xcG51XzTfJahEJecd9IQdxmdC0IsDeLrjNQ2WJmp0KG8nK/c7elZxSgJrC3ojZGG5LYrM41aOoE+Stl7zG6J3yp5XS1VbG6s" * 3]
    dentro = "Se demuestra que la función continua tiene un límite, as we shall see in the next chapter of this book, y el argumento se repite sin cambios para todos los casos."
    largo = "palabra" * 40_000
    filas = [("d", str(i), t) for i, t in enumerate(nada)] + [("d", "dentro", dentro), ("d", "largo", largo)]
    r = idioma.segmentos(spark.createDataFrame(filas, "documento_id string, id string, texto_plano string"), crf).orderBy("bloque_id", "n").collect()
    assert {x.bloque_id for x in r if x.pasaje} == {"dentro"}
    assert [x.idioma for x in r if x.bloque_id == "dentro"] == ["es", "en", "es"] and {x.idioma for x in r if x.bloque_id == "dentro" and x.pasaje} == {"es"}
    assert sum(x.palabras for x in r if x.bloque_id == "dentro") == len(idioma._palabras(dentro))
    assert idioma.rasgos(largo) != idioma.rasgos(largo[:-1] + "z")


def test_forward_backward_against_enumeration():
    crf = idioma.Crf()
    g = np.random.default_rng(0)
    crf.trans = g.standard_normal((5, 5)).astype(np.float32)
    e = g.standard_normal((1, 4, 5)).astype(np.float32)
    m = np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        s = np.exp(sum(e[0, i, y[i]] for i in range(4)) + sum(crf.trans[y[i], y[i + 1]] for i in range(3)))
        for i in range(4):
            m[i, y[i]] += s
    m /= m.sum(1, keepdims=True)
    vale = np.ones((1, 4), bool)
    assert np.allclose(crf.solo_marginales(e, vale)[0], m, atol=1e-4) and np.allclose(crf.marginales(e, vale)[0][0], m, atol=1e-4)


# ---- 4: truncation ----------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "valor,completo,nota,esperado",
    [
        ("La suma converge en todo el interv", ["La suma converge en todo el intervalo."], False, "cortado"),
        ("La suma converge.", ["La suma converge. La otra no."], False, "entero"),
        ("La suma converge en todo el intervalo.", [], False, "entero"),
        ("Se demuestra que la suma de los términos converge en todo el…", [], False, "cortado"),
        ("\\frac{1}{2", [], False, "cortado"),
        ("- uno\n- dos\n- tres", [], False, "libre"),
        ("Se demuestra que la suma converge en el intervalo abierto.\n12", [], False, "entero"),
        ("ver nota al pie", [], True, "libre"),
        ("Conviene volver a escanear esta hoja c", [], True, "cortado"),
    ],
)
def test_end_of_text(valor, completo, nota, esperado):
    assert truncado.fin_de(valor, completo, nota) == esperado


def test_spikes_and_nulls(spark):
    base = "Lista de palabras sueltas sin verbo alguno | tabla | celda " * 3
    filas = [(i, "r", None, base[:100], None, "") for i in range(20)] + [(100 + i, None, None, base[: 60 + i], "La nota está completa.", None) for i in range(20)]
    df = spark.createDataFrame(filas, "id long, revisor string, bloque_id string, contenido_original string, contenido_final string, comentarios string")
    df = df.unionByName(spark.createDataFrame([(500 + i, "r", None, base[i : i + 80] + str(i), None, "ver nota") for i in range(9)], df.schema)).withColumn("contenido_original", F.when(F.col("id") < 20, F.concat(F.substring("contenido_original", 1, 98), F.format_string("%02d", "id"))).otherwise(F.col("contenido_original")))
    p = truncado.picos(truncado.valores(df)).where("unidad = 'caracteres' and largo = 100").collect()
    assert [(r.fuente, r.campo, r.largo) for r in p] == [("r", "contenido_original", 100)]
    t = {(r.revisor, r.campo): r.n_cortados for r in truncado.tasas(df).collect()}
    assert t[("r", "contenido_original")] >= 20 and t[("r", "comentarios")] == 0 and t[(None, "contenido_final")] == 0
    assert truncado.cortados(df.limit(0)).count() == 0


# ---- 5: scans -----------------------------------------------------------------------------------------
def test_repair_of_lines():
    f = {"lineal-cuadrático": 50, "intervalo": 50, "lineal": 50, "cuadrático": 50}
    d, t, _ = escaneo.analizar("Basta comparar el operador lineal-\ncuadrático con otro en el int- \nervalo dado.", f)
    assert d == ["guion"] and t == "Basta comparar el operador lineal-cuadrático con otro en el intervalo dado."
    d, t, _ = escaneo.analizar("Se demuestra que la función con-\n— 20 —\ntinua tiene un límite en cada punto.", {"continua": 30})
    assert d == ["folio", "guion"] and "continua tiene" in t
    d, t, _ = escaneo.analizar("ESPACIO SEPARABLE    28\nNota. La figura 13 representa la integral lineal junto con otra.", {})
    assert d == ["encabezado", "folio"] and t.startswith("Nota.")
    assert escaneo.analizar("", {}) == ([], "", []) and escaneo.analizar("\n\n", {})[0] == []


def test_hyphens_do_not_depend_on_the_broadcast(spark):
    t = ["El operador lineal-\ncuadrático es continuo.", "El cálculo bien-\nestar del lector.", "Otro caso int-\nervalo de prueba.", "Sea un mal-\nen-\ntendido muy común.", "La serie pre-\nsocrática-\nlineal de los términos."]
    b = spark.createDataFrame([(str(i), x) for i, x in enumerate(t)], "id string, texto_plano string")
    o = spark.createDataFrame([("0", "El método auto-\nadjunto de siempre."), ("9", None)], "id string, contenido string")
    n = {"lineal-cuadrático": 50, "bienestar": 40, "bien-estar": 60, "intervalo": 30, "malentendido": 70, "mal-en-tendido": 90, "mal-en": 25, "malen": 22, "auto": 300, "adjunto": 24, "presocrática-lineal": 21, "de": 9000, "el": 8000, "poco": 3}
    v = spark.createDataFrame(list(n.items()), "palabra string, n long")
    r = lambda k: sorted((x.bloque_id, x.campo, x.defectos, x.reparado) for x in escaneo.analizados(escaneo.textos(b, o), v, con_texto=True, tasa=k).collect())
    a = r(1e-9)
    assert a == r(0.1) == r(1.0) and {x[3] for x in a} >= {"El operador lineal-cuadrático es continuo.", "El cálculo bien-estar del lector.", "El método auto-adjunto de siempre."}
    assert len(a) == 6


def test_corrections_by_anagram_difference(spark):
    v = spark.createDataFrame([("siempre", 900), ("siernpre", 12), ("función", 800), ("furición", 3), ("fumción", 2), ("mano", 700), ("rnano", 600), ("c0nstarite", 2), ("constante", 900)], "palabra string, n long")
    got = {r.palabra: (r.correccion, r.pasos) for r in escaneo.correcciones(v).collect()}
    assert escaneo.correcciones(v.limit(0)).count() == 0
    assert got == {"siernpre": ("siempre", 1), "furición": ("función", 1), "c0nstarite": ("constante", 2)}


def test_corrections_against_brute_force(spark):
    """Every place of every confusion, once and twice, over random words of any length."""
    g = random.Random(5)
    buenas = {"".join(g.choice("abcdehilmnorstuvw") for _ in range(n)): 5000 for n in [4, 5, 6, 7, 9, 12, 20, 45] * 3}

    def mal(w):
        a, b = g.choice([(a, b) for a, b in escaneo.CONFUSIONES if b in w])
        i = g.choice([i for i in range(len(w)) if w.startswith(b, i)])
        return w[:i] + a + w[i + len(b) :]

    def desde(w):
        return {w[:i] + b + w[i + len(a) :] for a, b in escaneo.CONFUSIONES for i in range(len(w)) if w.startswith(a, i)}

    malas = {mal(w) for w in buenas for _ in range(2)} | {mal(mal(w)) for w in buenas for _ in range(3)}
    malas -= set(buenas)
    v = spark.createDataFrame([*buenas.items(), *((w, 2) for w in malas)], "palabra string, n long")
    got = {r.palabra: r.correccion for r in escaneo.correcciones(v).collect()}
    esperado = {}
    for w in malas:
        uno = desde(w)
        c = sorted(x for x in uno if x in buenas) or (sorted({y for x in uno for y in desde(x) if y in buenas}) if len(w) >= 4 else [])
        if c:
            esperado[w] = c[0]
    assert got == esperado and len(got) > 80


def test_scan_defects_edges(spark):
    b, o = tabla(spark, "bloques"), tabla(spark, "ocr_resultados")
    r = escaneo.defectos(b, o)
    assert r.count() == r.distinct().count() > 0
    assert escaneo.defectos(b.limit(0), o.limit(0)).count() == 0


# ---- 6: quality -----------------------------------------------------------------------------------------
def test_quality_classes(spark):
    b = tabla(spark, "bloques").select("id", "documento_id", "tipo", "texto_plano")
    extra = [("x1", "L", "parrafo", "\n".join(f"- Grupo lineal {c}" for c in "abcdefgh")), ("x2", "T", "lista", "\n".join("12.5 & 7.1 & 33.0 \\\\" for _ in range(9))), ("x3", "G", "parrafo", "zq xv bnm kjh " * 12), ("x4", "N", None, None), ("x5", "N", "parrafo", "  ")]
    df = b.unionByName(spark.createDataFrame(extra, b.schema))
    got = dict(calidad.documentos_no_prosa(df.unionByName(df)).collect())
    assert got.get("L") == "lista" and got.get("T") == "tabla" and got.get("G") == "basura" and "N" not in got
    d = calidad.distancias(df).selectExpr("d2", "aggregate(contribuciones, 0D, (a, x) -> a + x) as s").collect()
    assert all(abs(r.d2 - r.s) < 1e-6 * max(1, abs(r.d2)) for r in d)
    assert calidad.documentos_no_prosa(df.limit(0)).count() == 0


# ---- 9: abusive content -----------------------------------------------------------------------------------
def test_gradient_of_network():
    g = np.random.default_rng(0)
    red = toxicidad.Red()
    red.p = {k: v.astype(np.float64) for k, v in red.p.items()}
    x = g.standard_normal((5, toxicidad.DW + toxicidad.DC))
    idx, vale = np.array([[0, 1, 2, 3], [4, 1, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    meta, peso = np.array([1.0, 0.0]), np.ones(2)

    def perdida():
        y, _ = red.adelante(x @ red.p["wf"] + red.p["bf"], x @ red.p["wb"] + red.p["bb"], idx, vale)
        return -(meta * np.log(y) + (1 - meta) * np.log(1 - y)).mean()

    gr, dx = red.gradiente(x, idx, vale, meta, peso)
    for k in ("wf", "ub", "uf", "a", "v", "o", "bb"):
        p, pos = red.p[k], tuple(n // 2 for n in red.p[k].shape)
        p0 = p[pos]
        p[pos] = p0 + 1e-2
        a = perdida()
        p[pos] = p0 - 1e-2
        b = perdida()
        p[pos] = p0
        assert abs((a - b) / 2e-2 - gr[k][pos]) < 2e-3, k
    x[1, 3] += 1e-2
    a = perdida()
    x[1, 3] -= 2e-2
    b = perdida()
    assert abs((a - b) / 2e-2 - dx[1, 3]) < 2e-3


def test_windows_cover_every_run():
    for n in (0, 1, 23, 24, 25, 37, 100):
        v = toxicidad.ventanas(n)
        assert all(any(i <= a and b <= j for i, j in v) for a in range(n) for b in (min(n, a + 12),))


def test_network_learns_and_edges(spark):
    neutro = ["la suma de los términos converge en el intervalo abierto dado por la función continua", "el grupo lineal conserva el orden de la sucesión en cada punto del espacio"]
    mal = ["eres un idiota cállate ya", "solo un payaso pregunta eso idiota", "ojalá te mueras payaso"]
    g = random.Random(1)
    textos, metas = [], []
    for i in range(120):
        t = " ".join(g.choice(neutro) for _ in range(3))
        k = i % 4 == 0
        textos.append(t + ". " + (g.choice(mal) + ". " if k else "") + g.choice(neutro))
        metas.append(float(k))
    red = toxicidad.entrenar(textos[:90], metas[:90])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(textos[90:])] + [(900, None), (901, ""), (902, " "), (903, "x " * 50_000)], "doc_id long, text string")
    r = {x.doc_id: x for x in toxicidad.puntuar(df, red).collect()}
    assert np.mean([(r[i].puntaje >= 0.5) == bool(m) for i, m in enumerate(metas[90:])]) > 0.9
    assert r[900].puntaje == r[901].puntaje == 0 and r[902].ventanas == 0 and r[903].ventanas > 1000
    assert isinstance(toxicidad.entrenar([], []), toxicidad.Red)
    p, m = np.array([0.1, 0.2, 0.62, 0.7, 0.9, 0.95]), np.array([0, 0, 0, 1, 1, 1])
    assert toxicidad.elegir_umbral(p, m) == 0.7 and toxicidad.elegir_umbral(p[:0], m[:0]) == toxicidad.UMBRAL_PREVIO


def test_masks_and_numbers():
    assert toxicidad.normalizar_trozo("m13rd4") == ["mierda"] and toxicidad.normalizar_trozo("i.d.i.o.t") == ["idiot"]
    assert toxicidad.normalizar_trozo("871t") == ["0t"] and toxicidad.normalizar_trozo("12") == ["0"]
    assert toxicidad.normalizar_trozo("a" + "bc" * 50) != toxicidad.normalizar_trozo("a" + "bc" * 49 + "bd")


def test_sample_of_judgements(spark):
    d = spark.createDataFrame([(i, f"texto {i}", ["es", "de", None][i % 3], "f") for i in range(60)] + [(60, None, "es", "f"), (3, "texto 3", "es", "f")], "doc_id long, text string, lang string, source string")
    e = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (4, None), (60, 1), (99, 1)], "doc_id long, toxic int")
    t, m, j = toxicidad.muestra_etiquetada(d, e)
    assert sorted((a, b) for a, b, c in zip(t, m, j) if c) == [("texto 1", 1.0), ("texto 3", 0.0)] and len(t) == len(set(t)) > 50 and all(b == 0 for b, c in zip(m, j) if not c)
    assert toxicidad.hallados(d, e.limit(0)).count() == 0 and toxicidad.tasas(d, e).count() == 1


def test_threshold_from_all_judged_documents(spark):
    """Documents beyond the sample of the training set the threshold too, long ones included."""
    g = random.Random(4)
    metas = {i: i % 3 == 0 for i in range(600)}
    puntos = {i: (0.55 if m else 0.1) + 0.3 * g.random() for i, m in metas.items()}
    d = spark.createDataFrame([(i, f"texto {i} " + "x" * (100_001 if i % 50 == 0 else 1), puntos[i]) for i in metas] + [(900, None, 0.0), (3, "texto 3 x", puntos[3])], "doc_id long, text string, puntaje double").withColumn("apartado", toxicidad.apartado())
    e = spark.createDataFrame([(i, int(m)) for i, m in metas.items()] + [(900, 1), (5, 1), (6, None)], "doc_id long, toxic int")
    muestra = set(toxicidad.muestra_etiquetada(d.select("doc_id", "text"), e, 100, 0)[0])
    fuera = [r.doc_id for r in d.where("text is not null").collect() if r.doc_id != 5 and (r.text not in muestra or zlib.crc32(r.text.encode()) % 5 == 0)]
    assert len(fuera) > 450 and sum(i % 50 == 0 for i in fuera) == 12
    assert toxicidad.umbral_de(d, e, 100) == toxicidad.elegir_umbral(np.array([puntos[i] for i in set(fuera)]), np.array([float(metas[i]) for i in set(fuera)]))
    bajos = d.withColumn("puntaje", F.when(toxicidad.en_muestra(599, 100), 0.95).otherwise(F.col("puntaje") / 2 + 0.05))
    assert toxicidad.umbral_de(bajos, e, 100) < 0.5  # what lies outside of the sample decides
