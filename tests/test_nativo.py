"""Native page text and recognition on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from legajo.functions import texto
from legajo.operators import disposicion, nativo, reconocimiento


def lineas(spark, filas):
    return spark.createDataFrame([("d", 0, 0, i, t, x0, y0, x0 + 50.0, y0 + 10.0, s, n) for i, (t, x0, y0, s, n) in enumerate(filas)], "documento_id string, pagina int, bloque int, seq int, texto string, x0 double, y0 double, x1 double, y1 double, tamano double, negrita boolean")


def test_rows_and_paragraphs(spark):
    f = nativo.filas(lineas(spark, [("mundo", 60.0, 0.2, 10.0, False), ("Hola", 0.0, 0.0, 10.0, True), ("sigue", 0.0, 12.0, 10.0, False), ("aparte", 0.0, 40.0, 10.0, False), ("• uno", 0.0, 52.0, 10.0, False), ("Tema ..... 4", 0.0, 64.0, 10.0, False), ("otra", 0.0, 76.0, 10.0, False)]))
    r = nativo.parrafos(f).orderBy("fila").collect()
    assert [x.texto for x in r] == ["Hola mundo", "sigue", "aparte", "• uno", "Tema ..... 4", "otra"]
    assert [x.parrafo for x in r] == [0, 0, 1, 2, 3, 4] and r[0].negrita is False
    assert nativo.parrafos(f.limit(0)).count() == 0


def test_body_size_and_margin(spark):
    f = lineas(spark, [("a" * 30, 10.0, 0.0, 10.02, False), ("b" * 5, 10.0, 12.0, 18.0, False), ("c" * 5, 5.0, 24.0, 18.0, False), ("d", 5.0, 36.0, 9.0, False)])
    assert nativo.tamano_cuerpo(f).first().cuerpo == 10.0 and nativo.margen_modal(f).first().margen == 5.0


def test_runs(spark):
    s = spark.createDataFrame([("d", 0, 0, i, t, m, float(i), 0.0, i + 1.0, 1.0) for i, (t, m) in enumerate([("Sea ", False), ("x", True), ("+1", True), (" real", False)])], "documento_id string, pagina int, linea int, seq int, texto string, formula boolean, x0 double, y0 double, x1 double, y1 double")
    assert [(r.texto, r.formula, r.x0, r.x1) for r in nativo.tramos(s).orderBy("tramo").collect()] == [("Sea ", False, 0.0, 1.0), ("x+1", True, 1.0, 3.0), (" real", False, 3.0, 4.0)]


@pytest.mark.parametrize(
    "filas,vocab,sale",
    [(["resour-", "ces here"], ["here"], "resources here"), (["second-", "year"], ["second", "year"], "second-year"), (["so­", "ft"], [], "soft"), (["uno", "", "dos"], [], "uno dos"), (["x-", "3"], [], "x-3"), ([], [], "")],
)
def test_join_of_rows(spark, filas, vocab, sale):
    df = spark.createDataFrame([(filas, vocab)], "f array<string>, v array<string>")
    assert df.select(nativo.unir_filas(F.col("f"), F.col("v")).alias("t")).first().t == sale


def test_vocabulary_leaves_out_halves(spark):
    df = spark.createDataFrame([("d", 0, 0, "gran resour-"), ("d", 0, 1, "  "), ("d", 0, 2, "ces here"), ("d", 0, 3, None)], "documento_id string, pagina int, seq int, texto string")
    assert {r.palabra for r in nativo.vocabulario(df).collect()} == {"gran", "here"}


def test_font_and_noise_rules(spark):
    df = spark.createDataFrame([("ABCDEF+CMMI10", 0), ("Times-Bold", 2), ("Arial", 16)], "f string, m int").select(nativo.es_matematica(F.col("f")).alias("a"), nativo.es_negrita(F.col("f"), F.col("m")).alias("b"), nativo.es_cursiva(F.col("f"), F.col("m")).alias("c"))
    assert [tuple(r) for r in df.collect()] == [(True, False, False), (False, True, True), (False, True, False)]
    r = spark.range(1).select(nativo.es_ruido(F.lit("14"), F.lit(9.0), F.lit(10.0), F.lit(5.0), F.lit(20.0), F.lit(800.0)).alias("a"), nativo.es_ruido(F.lit("14"), F.lit(10.0), F.lit(10.0), F.lit(5.0), F.lit(20.0), F.lit(800.0)).alias("b"), nativo.es_indice(F.lit(7.0), F.lit(10.0), F.lit(3.0), F.lit(5.0)).alias("c")).first()
    assert tuple(r) == (True, False, True)


def test_routes(spark):
    seg = "array<struct<tipo:string,contenido:string>>"
    f = [("ruido", "texto_nativo", None, "hibrido", False), ("parrafo", "requiere_ocr", None, "solo_ia", False), ("parrafo", "texto_nativo", None, "hibrido", False), ("parrafo", "texto_nativo", [("formula", "x")], "hibrido", False), ("parrafo", "requiere_ocr", None, "hibrido", True), ("tabla", "requiere_ocr", None, "hibrido", False), ("corolario", "requiere_ocr", None, "hibrido", False), ("lema", "requiere_ocr", None, "hibrido", False)]
    df = spark.createDataFrame(f, f"t string, o string, s {seg}, m string, x boolean").select(reconocimiento.ruta(F.col("t"), F.col("o"), F.col("s"), F.col("m"), F.col("x")).alias("r"))
    assert [r.r for r in df.collect()] == ["sin_reconocer", "solo_ia", "nativo", "nativo_con_formulas", "ya_transcrito", "tabla", "simple", "texto_con_formulas"]


def test_formulas_tables_correction(spark):
    s = spark.createDataFrame([("b", 0, "texto", "Sea"), ("b", 1, "formula", "x?"), ("b", 2, "formula", "y?")], "bloque_id string, idx int, tipo string, contenido string")
    r = spark.createDataFrame([("b", 1, "x^2", 0.9), ("b", 2, "y", 0.1)], "bloque_id string, idx int, latex string, confianza double")
    assert reconocimiento.sustituir_formulas(s, r).first().texto == "Sea $x^2$ y?"
    c = spark.createDataFrame([("t", 2, 2, 0, "a"), ("t", 2, 2, 1, None), ("t", 2, 2, 3, "d")], "bloque_id string, filas int, columnas int, pos int, contenido string")
    assert reconocimiento.recomponer_tabla(c).first().texto == "| a |  |\n| --- | --- |\n|  | d |"
    df = spark.createDataFrame([("codigo", "def f(x"), ("formula_display", r"\dfrac{1}{2"), ("parrafo", "vale $x{$"), ("parrafo", "(abierto"), ("parrafo", None)], "t string, x string").select(reconocimiento.corregir(F.col("t"), F.col("x")).alias("c"))
    assert [r.c for r in df.collect()] == ["def f(x", r"\frac{1}{2}", "vale $x{$}", "(abierto", ""]


def test_escalation_budget(spark):
    s = spark.createDataFrame([("d", p, f"b{p}", i) for p in range(4) for i in range(2)], "documento_id string, pagina int, bloque_id string, idx int")
    r = spark.createDataFrame([(f"b{p}", i, f"r{p}{i}", 0.9, 0.3) for p in range(4) for i in range(2) if (p, i) != (0, 1)], "bloque_id string, idx int, contenido string, confianza double, costo double")
    e = reconocimiento.escalar(s, r, 0.8)
    assert {(x.pagina, x.idx) for x in e.where("not requiere_revision_humana").collect()} == {(0, 0), (1, 0), (1, 1)}
    a = {x.bloque_id: x for x in reconocimiento.aplicar_a_bloques(e).collect()}
    assert a["b1"].contenido == "r11" and not a["b1"].requiere_revision_humana and a["b0"].requiere_revision_humana and a["b3"].contenido is None
    assert reconocimiento.escalar(s, r, 0.0).where("requiere_revision_humana").count() == 1


def test_native_pages_become_blocks(spark):
    f = []

    def linea(bloque, n, texto, y, tamano=10.0, fuente="Times", x=50.0, pagina=0):
        for k, p in enumerate(texto.split(" ")):
            f.append(("d", pagina, bloque, n, bloque * 1000 + n * 100 + k, p + " ", fuente, 0, tamano, x + 40 * k, y, x + 40 * k + 30, y + tamano))

    linea(0, 0, "Capítulo 3", 5.0, 8.0)
    linea(1, 0, "1.2 Anillos", 100.0, 14.0, "Times-Bold")
    linea(2, 0, "Teorema 1. Sea un resour-", 200.0)
    linea(2, 1, "ces here con second-", 212.0)
    linea(2, 2, "year y final.", 224.0)
    linea(2, 3, "   ", 236.0)
    linea(3, 0, "Tema ..... 4", 300.0)
    linea(4, 0, "here second year otras palabras de relleno para el cuerpo de la página", 400.0)
    s = spark.createDataFrame(f, "documento_id string, pagina int, bloque int, linea int, seq int, texto string, fuente string, marcas int, tamano double, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([("d", 0, 600.0, 800.0)], "documento_id string, pagina int, ancho double, alto double")
    r = nativo.bloques_de_paginas(s, p).orderBy("orden").collect()
    assert [(x.tipo, x.texto) for x in r] == [("ruido", "Capítulo 3"), ("encabezado", "1.2 Anillos"), ("teorema", "Teorema 1. Sea un resources here con second-year y final."), ("lista", "Tema … 4"), ("parrafo", "here second year otras palabras de relleno para el cuerpo de la página")]
    assert [x.orden for x in r] == [0, 1, 2, 3, 4] and all(0 <= x.bbox.x0 <= x.bbox.x1 <= 1 for x in r)
    assert nativo.bloques_de_paginas(s.limit(0), p).count() == 0


ESPANES = "documento_id string, pagina int, bloque int, linea int, seq int, texto string, fuente string, marcas int, tamano double, x0 double, y0 double, x1 double, y1 double"


def test_native_pages_read_their_spans_once(spark, tmp_path):
    """The plan stays small whatever is asked of a line; seq that starts anew in each block does not mix the lines of a page."""
    f = []
    for bloque, lineas_ in enumerate((["Sea un cons-", "truction dada"], ["otra cons-", "tante y truction"], ["cons", "fin"], ["x"], ["y"])):
        x, y = (0.0, 50.0 + 50.0 * bloque) if bloque < 3 else (300.0, 10.0 * bloque)
        for n, t in enumerate(lineas_):
            f += [("d", 0, bloque, n, n * 100 + k, p + " ", "Times", 0, 10.0, x + 20 * k, y + 12 * n, x + 20 * k + 15, y + 12 * n + 10) for k, p in enumerate(t.split(" "))]
    f.append((None, 0, 0, 0, 0, "sin documento", "Times", 0, 10.0, 0.0, 0.0, 1.0, 1.0))
    spark.createDataFrame(f, ESPANES).write.parquet(str(tmp_path / "s"))
    p = spark.createDataFrame([("d", 0, 600.0, 800.0)], "documento_id string, pagina int, ancho double, alto double")
    r = nativo.bloques_de_paginas(spark.read.parquet(str(tmp_path / "s")), p)
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 0 and plan.count("LogicalRDD") <= 8
    b = {x.bloque: x for x in r.collect()}
    assert b[0].texto == "Sea un cons-truction dada" and b[1].texto == "otra constante y truction"
    assert [b[k].orden for k in range(5)] == [0, 1, 2, 3, 4]  # the left column first


def test_native_lines_from_spans_within_them(spark):
    """Spans that come within their lines give the rows of the marked spans, also with several sizes and fonts, ties and empty texts."""
    g = random.Random(5)
    f = [("d", p, b, n, k, g.choice(["uno ", "x_2 ", "a\tb ", "", "  ", "ñandú­ "]), g.choice(["Times", "Times-Bold"]) if n else "Times", g.choice([0, 16]) if n == 2 else 0, g.choice([10.0, 10.02, 7.0]) if n > 1 else 10.0, g.random(), g.random(), g.random(), g.random())
         for p in range(3) for b in range(4) for n in range(5) for k in range(g.randrange(1, 9))]
    s = spark.createDataFrame(f, ESPANES)
    r = s.groupBy(*nativo.LINEA).agg(F.sort_array(F.collect_list(F.struct(*nativo.SPAN))).alias("s")).select(*nativo.LINEA, *[F.col("s")[c].alias(c) for c in nativo.SPAN])
    x, y = nativo.lineas_de_renglones(r), nativo.lineas_de_spans(nativo.marcar(s))
    assert len({z.tamano for z in x.collect()}) == 2 and sorted(map(tuple, x.collect())) == sorted(map(tuple, y.select(*x.columns).collect()))


def test_only_divided_words_move_after_the_page(spark):
    """The vocabulary is cut to the halves of divided words before it is shuffled; paragraphs without one are ready as they lie."""
    f = [("d", 0, b, n, n * 100 + k, p + " ", "Times", 0, 10.0, 20.0 * k, 50.0 * b + 12 * n, 20.0 * k + 15, 50.0 * b + 12 * n + 10) for b, ls in enumerate((["una cons-", "truction"], ["palabras sin nada"])) for n, l in enumerate(ls) for k, p in enumerate(l.split(" "))]
    r = nativo.bloques_de_paginas(spark.createDataFrame(f, ESPANES), spark.createDataFrame([("d", 0, 600.0, 800.0)], "documento_id string, pagina int, ancho double, alto double"))
    plan = r._jdf.queryExecution().sparkPlan()
    while plan.nodeName() != "Union":
        plan = plan.children().apply(0)
    assert "Join" not in (listo := plan.children().apply(0).toString()) and "Window" not in listo and "Aggregate" not in listo
    assert {x.texto for x in r.collect()} == {"una construction", "palabras sin nada"}
    v = spark.range(20000).select(F.lit("d").alias("documento_id"), F.concat(F.lit("p"), "id").alias("palabra"))
    pasan = {x.palabra for x in nativo.posibles(v, v.where("palabra in ('p7', 'p19999')")).collect()}
    assert {"p7", "p19999"} <= pasan and len(pasan) < 20
    p = spark.createDataFrame([("d", "p1", "p2"), ("d", "p1", "q"), ("e", "p1", "p2")], "documento_id string, izq string, der string")
    assert [tuple(x) for x in nativo.pares_propios(p, v).select("documento_id", "izq", "der").collect()] == [("d", "p1", "p2")]


def test_trimming_takes_what_the_pattern_takes(spark):
    """White space of every kind, and no other sign, goes from the ends of a text and is made single inside it."""
    f = spark.range(0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    f = f.select("c", F.concat("c", F.lit("x"), "c", F.lit("y "), "c").alias("t"))
    antes = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    limpio = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"(?U)\s+", " "), r"(?U)^\s+|\s+$", "")
    assert f.where(~texto.recortar(F.col("t")).eqNullSafe(antes) | ~texto.limpiar(F.col("t")).eqNullSafe(limpio)).count() == 0
    assert f.where(texto.recortar(F.col("c")) == "").count() == 25


def test_side_of_street_is_that_of_calles(spark):
    g = random.Random(3)
    f = [(f"d{d}", p, f"b{k}", x := g.choice([0.05, 0.1, 0.5, 0.55]) + g.random() * 0.03, y := g.random() * 0.9, x + g.choice([0.2, 0.35, 0.5]), y + 0.05) for d in range(12) for p in range(2) for k in range(g.randrange(1, 12))]
    c = spark.createDataFrame(f, "documento_id string, pagina int, bloque_id string, x0 double, y0 double, x1 double, y1 double")
    calle = {(x.documento_id, x.pagina): x.calle for x in disposicion.calles(c).collect()}
    r = disposicion.lado_de_calle(c, "lado").collect()
    assert 0 < len(calle) < 24 and len(r) == len(f) and all(x.lado == int(x.x1 > calle.get((x.documento_id, x.pagina), 9.0)) for x in r)


def test_segments_of_a_paragraph(spark):
    t = spark.createDataFrame([("d", 0, 0, 0, 0, 0, False, "Sea un resour-"), ("d", 0, 0, 0, 1, 0, False, "ces y "), ("d", 0, 0, 0, 1, 1, True, "x^2"), ("d", 0, 0, 0, 2, 0, True, "y"), ("d", 0, 0, 0, 2, 1, False, " fin"), ("d", 0, 0, 0, 3, 0, False, "")], "documento_id string, pagina int, bloque int, parrafo int, fila int, tramo int, formula boolean, texto string")
    assert [tuple(x) for x in nativo.segmentos_de_parrafo(t).first().segmentos] == [("texto", "Sea un resources y "), ("formula", "x^2"), ("formula", "y"), ("texto", " fin")]


def test_recognition_by_route(spark):
    b = [("ru", "ruido", "requiere_ocr", "hibrido", False, "x", 0.5, True), ("na", "parrafo", "texto_nativo", "hibrido", False, "tal cual", 0.5, True), ("nf", "parrafo", "texto_nativo", "hibrido", False, "plano", 0.5, True), ("ni", "parrafo", "texto_nativo", "hibrido", False, "plano", 0.5, False),
         ("tr", "parrafo", "requiere_ocr", "hibrido", True, "leído", 0.4, True), ("fd", "formula_display", "requiere_ocr", "hibrido", False, None, 0.5, True), ("ta", "tabla", "requiere_ocr", "hibrido", False, None, 0.5, True), ("tf", "lema", "requiere_ocr", "hibrido", False, None, 0.5, True),
         ("si", "lista", "requiere_ocr", "hibrido", False, None, 0.5, True), ("ia", "parrafo", "texto_nativo", "solo_ia", False, "no se mira", 0.5, True), ("va", "lista", "requiere_ocr", "hibrido", False, None, None, True)]
    s = [("nf", 0, "texto", "Sea"), ("nf", 1, "formula", "x?"), ("nf", 2, "formula", "y?"), ("ni", 0, "formula", "z"), ("tf", 0, "texto", None), ("tf", 1, "formula_inline", None)]
    r = [("nf", 1, "x^2", 0.9, None, None), ("nf", 2, "y{", 0.2, None, None), ("fd", -1, r"\frac{1}{2}", 1.0, None, None), ("ta", 0, "x^2+1", 0.8, "no", 0.1), ("ta", 1, "ab", 0.9, "texto", 0.6), ("tf", 0, None, None, "Sea", 1.0), ("tf", 1, "a", 1.0, None, None), ("si", -1, None, None, "uno", 0.1), ("ia", -1, "leído", 0.5, None, None)]
    c = [("ta", 1, 3, p) for p in range(3)]
    x = reconocimiento.reconocer(
        spark.createDataFrame(b, "bloque_id string, tipo string, origen string, modo string, transcrito boolean, texto string, confianza_layout double, hay_imagen boolean"), spark.createDataFrame(s, "bloque_id string, idx int, tipo string, contenido string"),
        spark.createDataFrame(c, "bloque_id string, filas int, columnas int, pos int"), spark.createDataFrame(r, "bloque_id string, idx int, latex string, conf_latex double, texto string, conf_texto double"),
    )
    got = {y.bloque_id: (y.ruta, y.contenido, len(y.micro_segmentos), round(y.confianza, 3), y.requiere_escalacion) for y in x.collect()}
    assert got == {
        "ru": ("sin_reconocer", "", 0, 1.0, False), "na": ("nativo", "tal cual", 0, 0.95, False), "nf": ("nativo_con_formulas", "Sea $x^2$ y?", 2, 0.595, True), "ni": ("nativo_con_formulas", "plano", 0, 0.7, False), "tr": ("ya_transcrito", "leído", 1, 0.4, True),
        "fd": ("formula_display", r"\frac{1}{2}", 1, 0.85, False), "ta": ("tabla", "| x^2+1 | texto |  |\n| --- | --- | --- |", 0, 0.7, False), "tf": ("texto_con_formulas", "Sea $a$", 2, 0.85, False), "si": ("simple", "uno", 1, 0.49, True), "ia": ("solo_ia", "leído", 1, 0.65, False), "va": ("simple", "", 0, 0.0, True),
    }


def test_answers_of_the_second_queue(spark):
    i = spark.createDataFrame([("d", "a", "x", 1), ("d", "b", "y", 2), ("e", "a", "z", 5)], "documento_id string, clase string, detalle string, pagina int")
    r = spark.createDataFrame([("d", "texto", 0.9, 0.5, False)], "documento_id string, contenido string, confianza double, costo double, requiere_revision_humana boolean")
    x = reconocimiento.resolver_inconsistencias(i, r)
    assert {(y.documento_id, y.clase, y.costo, y.costo_propio, y.requiere_revision_humana) for y in x.collect()} == {("d", "a", 0.5, 0.5, False), ("d", "b", 0.5, 0.0, False), ("e", "a", 0.0, 0.0, True)}
    b = spark.createDataFrame([("1", "e", 5), ("2", "e", 6), ("3", "d", 1), ("1", "e", 5)], "id string, documento_id string, pagina int")
    e = spark.createDataFrame([("d", "3", True), ("d", "4", False)], "documento_id string, bloque_id string, requiere_revision_humana boolean")
    assert {tuple(y) for y in reconocimiento.para_revision(b, e, x).collect()} == {("e", "1"), ("d", "3")}
