"""Document operators: literal cases, edge cases, invariance, streams, round trips."""

import json

import pytest
from pyspark.sql import functions as F

from legajo.functions import confianza, geometria, texto
from legajo.operators import consulta, correccion, disposicion, escaneado, estadisticas, reconocimiento, render, revision, traduccion
from legajo.operators.orden import numerar
from legajo.plans import consultas
from legajo.sources import tablas
from legajo.streaming import estado

SF = "/root/testdata/sf0.001"


def uno(spark, expr, valor, tipo="string"):
    return spark.createDataFrame([(valor,)], f"x {tipo}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "entra,sale",
    [
        (r"\dfrac{a}{b}", r"\frac{a}{b}"), (r"\tfrac{a}{b}", r"\frac{a}{b}"), (r"\varnothing", r"\emptyset"), (r"x \vert y", "x | y"), (r"\Vert v \Vert", r"\| v \|"), (r"\limit_{n}", r"\lim_{n}"),
        (r"\vertical", r"\vertical"), (r"\liminf_{n} a_n", r"\liminf_{n} a_n"), (r"a\,\,\,b", r"a\,b"), (r"\left( x + y \right)", "( x + y )"), ("x^ 2 + y_ 1", "x^2 + y_1"), ("", ""), (None, None),
        (r"\left( " + "x" * 40 + r"\right)", r"\left( " + "x" * 40 + r"\right)"),
    ],
)
def test_normalise_latex(spark, entra, sale):
    assert uno(spark, texto.normalizar_latex, entra) == sale


@pytest.mark.parametrize("entra,sale", [(r"\frac{a}{b", r"\frac{a}{b}"), (r"\frac{a}{b}}", r"{\frac{a}{b}}"), ("f(x", "f(x)"), (r"\begin{align} x = 1", "\\begin{align} x = 1\n\\end{align}"), (r"\begin{a}\begin{a}\end{a}", "\\begin{a}\\begin{a}\\end{a}\n\\end{a}"), ("", ""), (None, None)])
def test_repair(spark, entra, sale):
    assert uno(spark, texto.reparar_estructura, entra) == sale


@pytest.mark.parametrize("entra,ok", [("{(a)}", True), ("}{", False), ("(", False), ("", True)])
def test_valid_structure(spark, entra, ok):
    assert uno(spark, texto.estructura_valida, entra) is ok


@pytest.mark.parametrize(
    "entra,clase",
    [
        (None, "ruido"), ("   ", "ruido"), ("Teorema 3.2. Sea", "teorema"), ("LEMMA 4", "lema"), ("Definición 1", "definicion"), ("Proof. Trivial", "demostracion"), ("queda probado ∎", "demostracion"), ("Nota 3: x", "nota_pie"),
        ("- uno", "lista"), ("1) uno", "lista"), ("for i in range(10):", "codigo"), ("Se usa for en el texto:", "parrafo"), ("$$ x $$", "formula_display"), ("x ∈ A", "formula_inline"), ("Texto corrido", "parrafo"), (r"\[ x \]", "parrafo"),
    ],
)
def test_classes(spark, entra, clase):
    assert uno(spark, texto.clasificar, entra) == clase


def test_heading_needs_a_signal(spark):
    f = lambda c: texto.clasificar(c, escala=F.lit(1.2))
    assert uno(spark, f, "1.1 Grammar") == "encabezado" and uno(spark, f, "xvii") == "parrafo"


@pytest.mark.parametrize("expr,total,sale", [("1", 10, [0]), ("1-3", 10, [0, 1, 2]), ("1-2, 5", 10, [0, 1, 4]), ("3,1", 10, [0, 2]), ("1-2, 2-3", 10, [0, 1, 2]), ("", 3, [0, 1, 2]), ("8-999", 10, [7, 8, 9]), ("abc", 10, None), ("5-2", 10, None), ("0", 10, None), ("99", 10, None)])
def test_page_ranges(spark, expr, total, sale):
    r = spark.createDataFrame([(expr, total)], "e string, t int").select(texto.paginas(F.col("e"), F.col("t")).alias("p")).first().p
    assert r == sale


def test_numbers_and_confidence(spark):
    assert uno(spark, texto.numero, "Teorema 3.10. x") == [3, 10] and not uno(spark, texto.numero, "sin") and uno(spark, texto.numero, "9" * 20) == []
    assert uno(spark, lambda c: confianza.micro_segmento(F.lit(1.0), c, F.lit(False)), "texto") == pytest.approx(0.85)
    assert uno(spark, lambda c: confianza.micro_segmento(F.lit(1.0), c, F.lit(True)), "$x{") == pytest.approx(0.3)
    assert uno(spark, lambda c: geometria.normalizar(c, F.lit(0.0)), 5.0, "double") == 0.0 and uno(spark, lambda c: geometria.desnormalizar(c, F.lit(100)), 1.7, "double") == 100


def bloques(spark, filas):
    b = tablas.tabla(spark, SF, "bloques").limit(0)
    base = {c: None for c in b.columns}
    return spark.createDataFrame([tuple((base | f)[c] for c in b.columns) for f in filas], b.schema)


def test_gaps(spark):
    n = lambda i, t, d="d": {"id": str(i), "documento_id": d, "tipo": " Teorema", "pagina": 0, "texto_plano": t}
    h = lambda *ts: [(r.desde, r.hasta) for r in correccion.huecos_numeracion(correccion.numerados(bloques(spark, [n(i, t) for i, t in enumerate(ts)]))).collect()]
    assert h("Teorema 3.2", "Teorema 3.4") == [(2, 4)]
    assert h("Teorema 3.2", "Teorema 3.3") == h("Teorema 3.7", "Teorema 4.1") == h("Teorema 3.9", "Teorema 3.10") == []
    assert h("Teorema sin número", None, "") == []


def test_references(spark):
    b = bloques(spark, [{"id": "1", "documento_id": "d", "tipo": "teorema", "pagina": 0, "texto_plano": "Teorema 2.1. x"}, {"id": "2", "documento_id": "d", "tipo": "párrafo", "pagina": 1, "texto_plano": "Por el TEOREMA 2.1 y la Proposición 9 y la proposicion 8"}, {"id": "3", "documento_id": "d", "tipo": "parrafo", "pagina": 1, "texto_plano": None}])
    assert [(r.tipo_ref, r.num_ref) for r in correccion.referencias_colgadas(b).collect()] == [("proposicion", "9")]
    assert {r.bloque_id for r in correccion.paginas_inconsistentes(b).collect()} == {"2", "3"}


def test_structural_index_lists_every_entry(spark):
    f = lambda i, tipo, t, p=0: {"id": i, "documento_id": "d", "tipo": tipo, "pagina": p, "orden_lectura": int(i), "texto_plano": t}
    largo = "9" * 25
    b = bloques(spark, [f("1", "Encabezado ", "1.1 " + "x" * 60), f("2", "teorema", "Teorema 3.10"), f("3", "teorema", "Teorema 3.2", 5), f("4", "teorema", "sin número"), f("5", "teorema", f"Teorema {largo}"), f("6", "demostración", None, 2), f("7", "lema", None), f("8", "parrafo", "7"), f("9", "encabezado", None, 1)])
    r = correccion.indice_de_entradas(b.unionByName(b)).orderBy("clase", "posicion").collect()
    assert [(x.clase, x.posicion, x.numero, x.contenido, x.pagina, x.bloque_id) for x in r] == [
        ("demostracion", 1, None, None, 2, "6"), ("encabezado", 1, None, "1.1 " + "x" * 46, 0, "1"), ("encabezado", 2, None, "", 1, "9"), ("lema", 1, None, None, 0, "7"),
        ("teorema", 1, "3.2", None, 5, "3"), ("teorema", 2, "3.10", None, 0, "2"), ("teorema", 3, largo, None, 0, "5"), ("teorema", 4, None, None, 0, "4"),
    ]


def caja(i, x0, y0, x1, y1):
    return {"id": str(i), "documento_id": "d", "pagina": 0, "bbox": (x0, y0, x1, y1)}


def test_reading_order(spark):
    dos = bloques(spark, [caja(1, 0.1, 0.1, 0.45, 0.2), caja(3, 0.55, 0.1, 0.9, 0.2), caja(2, 0.1, 0.3, 0.45, 0.4), caja(4, 0.55, 0.3, 0.9, 0.4)])
    assert [r.bloque_id for r in disposicion.orden_de_lectura(dos).orderBy("orden").collect()] == ["1", "2", "3", "4"]
    titulo = bloques(spark, [caja(1, 0.1, 0.0, 0.9, 0.05), caja(2, 0.1, 0.1, 0.45, 0.2), caja(3, 0.55, 0.15, 0.9, 0.2), caja(4, 0.1, 0.3, 0.45, 0.4)])
    assert disposicion.calles(disposicion.cajas(titulo)).count() == 0
    assert [r.bloque_id for r in disposicion.orden_de_lectura(titulo).orderBy("orden").collect()] == ["1", "2", "3", "4"]
    assert disposicion.orden_de_lectura(titulo.limit(0)).count() == 0


def test_markdown_and_formats(spark):
    d = tablas.tabla(spark, SF, "documentos").limit(0)
    fila = {c: None for c in d.columns} | {"id": "d", "titulo": "c1.PDF"}
    docs = spark.createDataFrame([tuple(fila[c] for c in d.columns)], d.schema)
    f = lambda i, t, x: {"id": str(i), "documento_id": "d", "pagina": 0, "orden_lectura": i, "tipo": t, "texto_plano": x}
    b = bloques(spark, [f(0, "ruido", "14"), f(1, "encabezado", "1.1 Grammar"), f(2, "lista", "• uno"), f(3, "lista", "2) dos"), f(4, "parrafo", "Fin"), f(5, "codigo", "x = 1"), f(6, "teorema", "Teorema 1. Sea\nx"), f(7, "parrafo", "  ")])
    md = render.markdown(docs, b.unionByName(b)).first().texto
    assert md == "# c1\n\n<!-- página 1 -->\n\n### 1.1 Grammar\n\n- uno\n2) dos\n\nFin\n\n```\nx = 1\n```\n\n> **Teorema 1.** Sea\n> x\n"
    nb = json.loads(render.cuaderno(docs, b).first().json)
    assert [c["cell_type"] for c in nb["cells"]].count("code") == 1 and nb["nbformat"] == 4 and len(nb["cells"]) == 7
    g = json.loads(render.nodos(docs, b).first().json)
    assert g["total_bloques"] == 8 and g["bloques"][0]["confianza_global"] is None and g["bloques"][0]["revisado_por_humano"] is None and g["bloques"][1]["id"] == "1"
    assert render.latex(docs, b).first().texto.count("\\begin{theorem}") == 1
    b2 = bloques(spark, [f(0, "codigo", "a\\end{lstlisting}b ≤ c")])
    assert render.latex(docs, b2).first().texto.count("\\end{lstlisting}") == 1 and "b <= c" in render.latex(docs, b2).first().texto
    v = json.loads(render.volcado(docs, b).first().json)
    assert v["total_bloques"] == 8 and set(v["bloques"][0]) == set(b.columns) and set(v) == set(d.columns) - {"id"} | {"documento_id", "bloques"}
    assert render.markdown(docs, b.limit(0)).first().texto == "# c1\n"
    with pytest.raises(ValueError):
        render.renderizar("otro", docs, b)
    tr = spark.createDataFrame([("4", "End", "")], "bloque_id string, contenido string, contenido_final string")
    assert "\n\nEnd\n" in render.markdown(docs, render.traducidos(b, tr)).first().texto


LATEX = {k: render.Tabla(*v) for k, v in render._TABLAS.items()}


@pytest.mark.parametrize("tabla,modo", [("SIMBOLOS", "formula"), ("SIMBOLOS", "prosa"), ("ESCAPES", "prosa"), ("EN_CODIGO", "codigo")])
def test_every_entry_of_the_character_tables(tabla, modo):
    import unicodedata

    t = getattr(render, tabla)
    assert all(render.pdflatex(f"a{k}b", modo, LATEX) == f"a{t.get(unicodedata.normalize('NFC', k), v)}b" for k, v in t.items())


@pytest.mark.parametrize(
    "modo,entra,sale",
    [
        ("prosa", "100% & _x_", r"100\% \& \_x\_"), ("prosa", "\\{", r"\textbackslash\{\}\{"), ("prosa", "=\u0338 e\u0301 ５ Ω", r"$\neq$ é 5 $\Omega$"), ("prosa", "а\u200bж", ""), ("formula", r"\frac{x}{2} ≤ ℝ²", r"\frac{x}{2} $\leq$ $\mathbb{R}$$^{2}$"),
        ("mixto", "50% de $x_1≤2$ y {", r"50\% de $x_1$\leq$2$ y \{"), ("mixto", "uno $ solo", r"uno \$ solo"), ("mixto", "", ""), ("codigo", "if a ≤ b → c “q” … ½", 'if a <= b -> c "q" ... ½'), ("prosa", "½ ⌈x⌉ ″ ↑ ⩽", r"$\frac{1}{2}$ $\lceil$x$\rceil$ $''$ $\uparrow$ $\leq$"),
    ],
)
def test_latex_modes(modo, entra, sale):
    assert render.pdflatex(entra, modo, LATEX) == sale


@pytest.mark.parametrize(
    "entra,sale",
    [
        ("Sea $x$ y $$z$$.", [("texto", "Sea"), ("formula_inline", "$x$"), ("texto", "y"), ("formula_inline", "$$z$$"), ("texto", ".")]), (r"a \\[x=1\\] b", [("texto", "a"), ("formula_inline", r"\\[x=1\\]"), ("texto", "b")]),
        (r"a \[x=1\] b", [("texto", r"a \[x=1\] b")]), ("$a\nb$", [("formula_inline", "$a\nb$")]), ("", [("texto", "")]), (None, [("texto", "")]), ("5 $ solo", [("texto", "5 $ solo")]),
    ],
)
def test_formula_segments(spark, entra, sale):
    """Display LaTeX counts with two backslashes only, as the recognisers write it."""
    assert [tuple(x) for x in uno(spark, texto.segmentos_de_formula, entra)] == sale


def test_query_surface(spark):
    f = lambda i, p, t, c, e="pendiente": {"id": i, "documento_id": "d", "pagina": p, "orden_lectura": int(i), "tipo": t, "confianza_global": c, "estado_revision": e, "texto_plano": "x"}
    b = bloques(spark, [f("1", 0, "parrafo", 0.5), f("2", 0, "lema", 0.9), f("3", 1, "parrafo", None), f("4", 1, "parrafo", 0.7, "resuelto")])
    b = b.unionByName(b)
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(consulta.bloques_filtrados(b)) == ["1", "2", "3", "4"] and ids(consulta.bloques_filtrados(b, 0, ["parrafo"], "pendiente", 0.7)) == ["1"] and ids(consulta.bloques_filtrados(b, confianza_max=0.7)) == ["1", "4"]
    assert "texto_plano" in consulta.bloques_filtrados(b, incluir=("texto_plano",)).columns and ids(consulta.bloque(b, "d", "2")) == ["2"] and ids(consulta.bloque(b, "otro", "2")) == []
    assert ids(consulta.pagina_de_bloques(b, "d", 1, (0, 1))) == ["2", "3"] and [r.id for r in consulta.pagina_de_bloques(b, "d", por_confianza=True).collect()] == ["1", "4", "2", "3"]
    with pytest.raises(ValueError):
        consulta.bloques_filtrados(b, incluir=("clave",))
    r = spark.createDataFrame([("auto",), (None,), (" ",), ("71",), ("72",), ("600",), ("601",), ("x",), ("-80",)], "x string").select("x", consulta.dpi_valido(F.col("x")).alias("d")).collect()
    assert [(x.x, x.d.dpi) for x in r if x.d.valido] == [("auto", None), (None, None), (" ", None), ("72", 72), ("600", 600)]
    assert [uno(spark, consulta.modo_valido, m) for m in (None, " ", "SOLO_IA ", "otro")] == ["hibrido", "hibrido", "solo_ia", None]


def test_places_add_up_over_buckets(spark):
    filas = [(g, c, i) for i, (g, c) in enumerate([("a", 2), ("a", 1), ("a", None), ("a", 2), (None, 5), ("b", 1), (None, 4)])]
    r = numerar(spark.createDataFrame(filas, "g string, c int, i int"), "g", F.col("c"), ["i"], "k").collect()
    assert {(x.g, x.c, x.i): x.k for x in r} == {("a", None, 2): 1, ("a", 1, 1): 2, ("a", 2, 0): 3, ("a", 2, 3): 4, (None, 4, 6): 1, (None, 5, 4): 2, ("b", 1, 5): 1}


def test_statistics_without_rows(spark):
    d, b, o = tablas.tabla(spark, SF, "decisiones").limit(0), tablas.tabla(spark, SF, "bloques").limit(0), tablas.tabla(spark, SF, "documentos").limit(0)
    assert estadisticas.potencial(d).first().potencial == 0.0 and estadisticas.acierto_del_modelo(d).first().acierto == 0.0 and estadisticas.retroalimentacion(d).count() == 0
    m = estadisticas.metricas(o, b, d).first()
    assert m.documentos == m.bloques == m.decisiones == 0 and m.cambio == 0.0 and m.confianza is None
    assert estadisticas.diferencias(d.select(F.col("contenido_original").alias("a"), F.col("contenido_final").alias("b"))).first().porcentaje == 0.0


def test_feedback_proposals(spark):
    f = lambda i, t, k, ce, cu: (i, "d", "b", 0, t, k, None, None, ce, None, cu, None, None, None)
    d = spark.createDataFrame([f(i, "parrafo", "rechazar" if i < 2 else "escalar", 0.9, 0.3) for i in range(4)] + [f(9, "lema", "aceptar", 0.1, 0.9)], tablas.ESQUEMA_DECISIONES)
    r = {(x.tipo_bloque, x.capa): (round(x.actual, 2), round(x.recomendado, 2), x.regla) for x in estadisticas.retroalimentacion(d).collect()}
    assert r == {("parrafo", 3): (0.75, 0.85, "rechazo"), ("parrafo", 4): (0.8, 0.7, "escalacion"), ("lema", 3): (0.7, 0.65, "confianza")}
    u = spark.createDataFrame([("global", "parrafo", 0.75), ("global", "figura", 0.0)], "ambito string, clave string, valor double")
    a = {x.clave: (x.antes, round(x.despues, 2)) for x in revision.aplicar_recomendaciones(d, u).collect()}
    assert a == {"parrafo": (0.75, 0.75), "figura": (0.0, 0.0), "lema": (None, 0.65)}


def test_translation_job(spark):
    b = bloques(spark, [{"id": f"{i:02d}", "documento_id": "d", "pagina": i // 5, "orden_lectura": i, "tipo": "parrafo", "texto_plano": "x" * 10} for i in range(30)])
    r = spark.createDataFrame([(f"{i:02d}", f"t{i}") for i in range(30)], "bloque_id string, contenido string")
    t, e = traduccion.trabajar(b, r, 0.01, 2.0)
    assert sorted(x.bloque_id for x in t.collect()) == [f"{i:02d}" for i in range(24)] and tuple(e.first()) == ("d", 3, 2, True)
    a = spark.createDataFrame([(1, 'sí: [{"id":"a","texto":"uno"},{"id":"b"},{"texto":"x"}] fin'), (2, "nada"), (3, "[roto"), (4, None)], "id int, respuesta string")
    assert [tuple(x) for x in traduccion.respuestas(a).collect()] == [(1, "a", "uno")]
    p = spark.range(1).select(traduccion.instrucciones(F.lit("inglés"), F.lit(" "), F.lit("Tono."), F.lit("  anillo → ring")).alias("p")).first().p
    assert p.startswith("Traducí al inglés.\n\nTono.\n\nRespetá") and p.count("\n\n") == 3


def test_cursor_walks_all_documents(spark):
    d = tablas.tabla(spark, SF, "documentos")
    vistos, cursor = [], None
    while True:
        r = revision.pagina_de_documentos(d, 15, cursor).collect()
        vistos += [x.id for x in r[:15]]
        if len(r) <= 15:
            break
        cursor = revision.cifrar_cursor(r[14].micros, r[14].id)
    assert len(vistos) == len(set(vistos)) == d.select("id").distinct().count()
    with pytest.raises(ValueError):
        revision.descifrar_cursor("no es un cursor")


def test_recommendations_keep_their_rules(spark):
    e = tablas.ESQUEMA_DECISIONES
    f = lambda i, t, k, ce, cu: (i, "d", "b", 0, t, k, None, None, ce, None, cu, None, None, None)
    d = spark.createDataFrame([f(i, "parrafo", "rechazar", 0.9, 0.3) for i in range(4)] + [f(9, "figura", "aceptar", 0.1, 0.9), f(10, "", "rechazar", 0.1, 0.1)], e)
    u = spark.createDataFrame([("global", "parrafo", 0.75), ("global", "figura", 0.0)], "ambito string, clave string, valor double")
    r = {x.tipo_bloque: x for x in revision.recomendaciones(d, u).collect()}
    assert set(r) == {"parrafo", "figura"} and r["parrafo"].nuevo > 0.75 and not r["parrafo"].aplicable and r["figura"].nuevo == 0.5


def test_terms(spark):
    b = bloques(spark, [{"id": "1", "documento_id": "d", "tipo": "parrafo", "texto_plano": "Eigenvalue " * 5 + "ring " * 4 + "raro the the the the"}, {"id": "2", "documento_id": "d", "tipo": "codigo", "texto_plano": "codigo " * 9}])
    assert {(r.termino, r.apariciones) for r in revision.terminos(b).collect()} == {("Eigenvalue", 5), ("ring", 4)}


def test_suggestions_against_brute_force(spark):
    dic = ["teorema", "demostración", "espacio", "vectorial", "esta", "esto", "función"]
    pal = ["teorena", "demostracion", "espaxio", "vectrial", "estas", "zzzzz", "función", "funcionn", "esp", None]

    def lev(a, b):
        f = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            g = [i]
            for j, y in enumerate(b, 1):
                g.append(min(f[j] + 1, g[-1] + 1, f[j - 1] + (x != y)))
            f = g
        return f[-1]

    esperado = {}
    for p in pal:
        if p and p not in dic:
            c = sorted((lev(p, q) / max(len(p), len(q)), q) for q in dic if 5 * lev(p, q) <= max(len(p), len(q)))
            if c:
                esperado[p] = c[0][1]
    r = correccion.sugerencias(spark.createDataFrame([(x,) for x in pal], "palabra string"), spark.createDataFrame([(x,) for x in dic], "palabra string")).collect()
    assert {x.palabra: x.sugerencia for x in r} == esperado and esperado


def test_suggestions_have_no_bound_on_length(spark):
    import random

    azar = random.Random(4)
    letra = lambda: azar.choice("abcdeñ")
    dic = ["".join(letra() for _ in range(n)) for n in (1, 3, 5, 8, 12, 13, 14, 15, 16, 17, 19, 20, 21, 24, 25, 29, 40, 61) for _ in range(2)] + ["suficientemente", "mannigfaltigkeit"]
    pal = ["siificientemente", "suficicntemente", "mannigfaltigkcit", "x", ""]
    for q in dic:
        for cambios in range(1, len(q) // 4 + 2):
            for forma in ("mixta", "quita", "pone", "cambia"):
                x = list(q)
                for _ in range(cambios):
                    k = azar.randrange(len(x)) if x else 0
                    que = azar.choice(("quita", "pone", "cambia")) if forma == "mixta" else forma
                    x[k : k + (que != "pone")] = [] if que == "quita" else [letra()]
                pal.append("".join(x))
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "palabra string")
    lev = df([x for x in set(pal) if x and x not in dic]).crossJoin(df(dic).distinct().withColumnRenamed("palabra", "q")).selectExpr("palabra", "q", "levenshtein(palabra, q) d", "greatest(length(palabra), length(q)) m")
    esperado = {r.palabra: r.x.q for r in lev.where("5 * d <= m").groupBy("palabra").agg(F.min(F.struct((F.col("d") / F.col("m")).alias("r"), "q")).alias("x")).collect()}
    r = {x.palabra: x.sugerencia for x in correccion.sugerencias(df(pal), df(dic)).collect()}
    assert r == esperado and len(r) > 300 and r["siificientemente"] == "suficientemente" and r["mannigfaltigkcit"] == "mannigfaltigkeit"


def test_blocks_are_corrected_with_spelling(spark):
    f = lambda i, tipo, t: {"id": i, "documento_id": "d", "tipo": tipo, "pagina": 0, "texto_plano": t}
    casos = {
        "1": ("Párrafo", "El Teorena, tenia un espacio. Seria teorena\n", "El Teorema, tenía un espacio. sería teorema\n"), "2": ("código", "teorena tenia", "teorena tenia"),
        "3": ("formula_display", r"\dfrac{teorena}{vectos", r"\frac{teorena}{vector}"), "4": ("parrafo", " \n", ""), "5": ("lista", None, ""), "6": (None, "vectos y ESPACIP", "vectos y Espacio"),
    }
    df = lambda *xs: spark.createDataFrame([(x,) for x in xs], "palabra string")
    b = bloques(spark, [f(i, t, x) for i, (t, x, _) in casos.items()])
    r, inc = reconocimiento.corregir_documento(b.unionByName(b), df("el", "teorema", "espacio", "un", "tenía", "sería"), df("vector", "frac"))
    assert {x.bloque_id: x.texto for x in r.collect()} == {i: s for i, (_, _, s) in casos.items()} and r.count() == len(casos) and inc.count() == 0


def test_bleu_bounds(spark):
    p = spark.createDataFrame([(1, "a b c d e f", "a b c d e f"), (2, "g h i j k", "g h i j k")], "id long, candidato string, referencia string")
    assert revision.bleu(p).first().bleu == pytest.approx(1.0)
    assert revision.bleu(p.withColumn("candidato", F.lit("z y x w v"))).first().bleu == 0.0
    assert revision.bleu(p.limit(0)).first().bleu == 0.0


def test_sinks_round_trip(spark, tmp_path):
    d = tablas.tabla(spark, SF, "decisiones").dropDuplicates(["id"])
    tablas.agregar_jsonl(d, str(tmp_path / "j"))
    tablas.agregar_jsonl(d.limit(3), str(tmp_path / "j"))
    assert tablas.leer_jsonl(spark, str(tmp_path / "j")).count() == d.count() + 3
    tablas.exportar_csv(d.select("id", "contenido_original"), str(tmp_path / "c"))
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert r.count() == d.count()
    viejo, nuevo = spark.createDataFrame([("a", 1), ("b", 1)], "pdf string, v int"), spark.createDataFrame([("b", 2)], "pdf string, v int")
    assert sorted(map(tuple, tablas.fusionar_manifiesto(viejo, nuevo).collect())) == [("a", 1), ("b", 2)]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    h = 1.7e9
    filas = [("acceso", "1.1.1.1", h + 60 * i) for i in range(14)] + [("acceso", "1.1.1.1", h + 5000), ("otro", "2.2.2.2", h + 1)]
    df = spark.createDataFrame(filas, "accion string, ip string, ts double")
    lote = sorted(map(tuple, estado.limitar_lote(df).collect()))
    assert sum(not x[3] for x in lote) == 4
    df.coalesce(1).write.json(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    assert sorted(map(tuple, estado.drenar(estado.limitar(s), spark, "limite", "append", str(tmp_path / "ck")).collect())) == lote


def test_progress_stream_and_silence(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, "inicio", "2026-01-01 00:00:00"), ("d", 1, "fin", "2026-01-01 00:05:00"), ("d", 2, "inicio", "2026-01-01 02:00:00")], "documento_id string, capa int, estado string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert {(r.capa, r.estado) for r in estado.drenar(estado.progreso(s), spark, "progreso", "complete", str(tmp_path / "ck1")).collect()} == {(1, "fin"), (2, "inicio")}
    r = estado.drenar(estado.silenciosos(s), spark, "silencio", "append", str(tmp_path / "ck2")).collect()
    assert [x.latidos for x in r] == [2]


@pytest.mark.parametrize("nombre", ["w2_zonas", "w9_orden_de_lectura", "r1_markdown", "a12_resumen_por_documento", "f5_cola_de_revision"])
def test_results_do_not_depend_on_partitions(spark, nombre):
    q = consultas.queries()[nombre]
    a = sorted(map(str, q(spark, SF).collect()))
    antes = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = sorted(map(str, q(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", antes)
    assert a == b and a


def test_filters_reach_the_scan(spark):
    d = tablas.tabla(spark, SF, "documentos").where("estado = 'completado'").select("id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(estado), EqualTo(estado,completado)]" in plan and "ReadSchema: struct<id:string,estado:string>" in plan


def test_sources_and_migration(spark, tmp_path):
    u = tablas.tabla(spark, SF, "umbrales")
    tablas.guardar_umbrales(u, str(tmp_path / "u"))
    assert sorted(map(tuple, tablas.leer_umbrales(spark, str(tmp_path / "u")).collect())) == sorted(map(tuple, u.collect()))
    otro = spark.createDataFrame([("global", "parrafo", 0.1), ("nuevo", "x", 0.5)], u.schema)
    assert {(r.ambito, r.clave) for r in tablas.leer_umbrales(spark, str(tmp_path / "u"), otro).collect()} == {(r.ambito, r.clave) for r in u.collect()} | {("nuevo", "x")}
    c = tablas.tabla(spark, SF, "costos")
    tablas.agregar(c, str(tmp_path / "c"))
    tablas.agregar(c.limit(2), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == c.count() + 2
    for n, t in (("a.pdf", b" \n%PDF-1.7 x"), ("b.pdf", b""), ("c.pdf", b"<html>")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / n).write_bytes(t)
    a = tablas.archivos(spark, str(tmp_path / "in"))
    r = {x.path[-5:]: x.f for x in a.select("path", tablas.fallo_de_archivo(F.col("length"), F.substring(F.col("content"), 1, 64).cast("string"), F.lit(3)).alias("f")).collect()}
    assert r == {"a.pdf": None, "c.pdf": "no_es_pdf"}  # the reader passes over empty files
    x = spark.createDataFrame([(0, "", 1), (None, None, None), (60_000_000, "%PDF-", 1), (9, "%PDF-", None), (9, "%PDF-", 1001), (9, "%PDF-", 1000)], "l int, i string, p int").select(tablas.fallo_de_archivo(F.col("l"), F.col("i"), F.col("p")).alias("f"))
    assert [y.f for y in x.collect()] == ["vacio", "vacio", "muy_grande", "sin_paginas", "demasiadas_paginas", None]
    g = spark.createDataFrame([(2, "b"), (1, "a")], "id int, v string")
    m = tablas.migrar(g, {"w": 5, "v": "no"}, ("x",), unica=True)
    assert [tuple(x) for x in tablas.migrar(m, {"w": 9}).collect()] == [(1, "a", 5)] and tablas.migrar(g, fuera=("v",)).columns == ["id"]


def test_page_selection(spark):
    p = spark.createDataFrame([("a", n, n * 10) for n in range(4)] + [("b", 0, 7)], "documento_id string, pagina int, v int")
    r = tablas.extraer_paginas(p, spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 9)], "documento_id string, pagina int"))
    assert sorted(map(tuple, r.collect())) == [("a", 0, 10, 1), ("a", 1, 30, 3), ("b", 0, 7, 0)]


def test_ambiguous_repairs(spark):
    assert [uno(spark, texto.reparacion_ambigua, x) for x in ("{a", "a}", "a)", r"\end{x}", r"\begin{x}\end{x}", "", "(a")] == [False, True, True, True, False, False, False]
    c = spark.createDataFrame([("1", "a}", "{a}", False), ("2", "}{", "}{", True), ("3", "x", "x", False), ("4", None, None, False)], "bloque_id string, antes string, despues string, ortografia boolean")
    assert {tuple(r) for r in correccion.reparaciones_por_escalar(c).collect()} == {("1", "ambigua"), ("2", "desequilibrada"), ("2", "ortografia")}
    d = lambda *xs: spark.createDataFrame([(x,) for x in xs], "palabra string")
    assert correccion.diccionario(d("a", "b"), d("b", "c")).count() == 3 and correccion.diccionario(d("a"), d("b"), "tecnico").first()[0] == "b"
    with pytest.raises(ValueError):
        correccion.diccionario(d("a"), d("b"), "otro")


def test_scanned_components(spark):
    filas = [("d", 0, "b", str(i), x, y, w, h, a) for i, (x, y, w, h, a) in enumerate([(0, 0, 10, 10, 60), (20, 0, 10, 10, 60), (40, 0, 40, 2, 60), (90, 0, 40, 2, 60), (140, 0, 10, 10, 60), (0, 60, 40, 2, 60), (50, 60, 10, 10, 60), (0, 0, 2, 2, 3)])]
    c = spark.createDataFrame(filas, "documento_id string, pagina int, bloque_id string, id string, x int, y int, w int, h int, area int")
    k = escaneado.componentes(c)
    assert {r.id for r in k.where("es_formula").collect()} == {"2", "3", "5"} and k.count() == 7
    t = escaneado.tramos(escaneado.lineas(k)).orderBy("linea", "tramo").collect()
    assert [(r.linea, r.tipo, r.n, r.x0, r.x1) for r in t] == [(0, "texto", 2, 0, 35), (0, "formula_inline", 2, 35, 135), (0, "texto", 1, 135, 155), (1, "texto", 2, 0, 65)]
    g = escaneado.rejilla(c, spark.createDataFrame([("b", 90, 60)], "bloque_id string, ancho int, alto int")).orderBy("pos").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in g] == [(0, 0, 45, 30), (45, 0, 90, 30), (0, 30, 45, 60), (45, 30, 90, 60)]
    assert escaneado.tramos(escaneado.lineas(escaneado.componentes(c.limit(0)))).count() == 0


def test_live_recommendations_equal_batch(spark, tmp_path):
    d = tablas.tabla(spark, SF, "decisiones").dropDuplicates(["id"]).select("tipo_bloque", "decision", "confianza_engine", "confianza_usuario")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    u = tablas.tabla(spark, SF, "umbrales")
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    r = estado.drenar(estado.recomendaciones_vivas(s, u), spark, "vivas", "complete", str(tmp_path / "ck"))
    f = lambda x: sorted((y.tipo_bloque, round(y.nuevo, 9), y.aplicable) for y in x.collect())
    assert f(r) == f(revision.recomendaciones(tablas.tabla(spark, SF, "decisiones"), u)) and r.count() > 0
    e = spark.createDataFrame([("d", n, 250) for n in range(1, 251)], "documento_id string, n int, total int")
    assert estado.espaciado(e).count() == 125 and estado.espaciado(e.limit(0)).count() == 0
