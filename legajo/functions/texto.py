"""Text rules as ``Column`` expressions; all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACENTOS = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1}
#: What ``(?U)\s`` matches.
BLANCOS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def recortar(c: Column) -> Column:
    """Strip any Unicode white space from both ends."""
    return F.btrim(c, F.lit(BLANCOS))


def tipo_normal(c: Column) -> Column:
    """Hand-written type without case, accents and outer spaces."""
    return F.lower(recortar(F.translate(c, "".join(_ACENTOS), "".join(_ACENTOS.values()))))


def limpiar(c: Column) -> Column:
    """Control characters out, white space to single spaces, ends stripped."""
    limpio = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"(?U)\s+", " ")
    # most texts hold single spaces alone, which one look tells
    return recortar(F.when(c.rlike(f"[\x00-\x1f\x7f{BLANCOS[6:]}]|  "), limpio).otherwise(c))


def primero_no_vacio(*cs: Column) -> Column:
    """First value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


# --- fixed values: opening keywords of the block classes ---------------------------------------
INICIOS = (
    ("teorema", r"^(teorema|theorem)\s+\d+"),
    ("lema", r"^(lema|lemma)\s+\d+"),
    ("proposicion", r"^(proposici[óo]n|proposition)\s+\d+"),
    ("definicion", r"^(definici[óo]n|definition)\s+\d+"),
    ("corolario", r"^(corolario|corollary)\s+\d+"),
    ("demostracion", r"^(proof|prueba|demostraci[óo]n)\s*[.:]"),
)
#: The first four letters of every keyword, of NOTA's too.
COMIENZOS = ("teor", "theo", "lema", "lemm", "prop", "defi", "coro", "proo", "prue", "demo", "nota", "note")
NOTA = r"^(nota|note)\s*\d*\s*[.:]"
LISTA = r"^(\s*[-•*]|\s*\d+[.)]\s+)"
CODIGO = r"^\s*(def |class |function |for |while |if |elif |else:|return |import |from |print\(|#include|<\?|\{)"
NUMERACION = r"^[\d ivxlcdmIVXLCDM.,)(-]+$"
DISPLAY = r"^\s*(\$\$|\\\\\[)|(\$\$|\\\\\])\s*$"
SIMBOLOS = r"[α-ωΑ-Ω∫∑∏∂∇∞∀∃∈∉⊂⊃∪∩]"
ENUNCIADO = r"^((?:teorema|theorem|lema|lemma|proposici[óo]n|proposition|definici[óo]n|definition|corolario|corollary|proof|prueba|demostraci[óo]n)(?:\s+\d+(?:\.\d+)*)?(?:\s*\([^)]{0,60}\))?\s*[.:])\s*"
EQUIVALENCIAS = ((r"\varnothing", r"\emptyset"), (r"\dfrac", r"\frac"), (r"\tfrac", r"\frac"), (r"\limit", r"\lim"), (r"\vert", "|"), (r"\Vert", r"\|"))
# --- end of fixed values -----------------------------------------------------------------------


def clasificar(texto: Column, negrita: Column | None = None, escala: Column | None = None, filas: Column | None = None) -> Column:
    """Block class by the first rule that holds; null and blank texts are noise.

    Without typographic signals nothing is bold, the scale is 1 and there is one line.
    """
    negrita = F.lit(False) if negrita is None else F.coalesce(negrita, F.lit(False))
    escala = F.lit(1.0) if escala is None else F.coalesce(escala, F.lit(1.0))
    filas = F.lit(1) if filas is None else F.coalesce(filas, F.lit(1))
    bajo = recortar(F.lower(texto))
    # most texts begin with no keyword, and are not looked at pattern by pattern in lower case
    palabra = F.lower(F.substring(recortar(texto), 1, 4)).isin(*COMIENZOS)
    inicio = F.when(bajo.rlike(INICIOS[0][1]), INICIOS[0][0])
    for clase, patron in INICIOS[1:]:
        inicio = inicio.when(bajo.rlike(patron), clase)
    regla = F.when(texto.contains("∎") | texto.contains(r"\qed"), "demostracion").when(palabra & bajo.rlike(NOTA), "nota_pie").when(texto.rlike(LISTA), "lista")
    regla = regla.when(texto.rlike(CODIGO) & (negrita | F.regexp_replace(texto, r"(?U)\s+$", "").endswith(":") | texto.contains("\n")), "codigo")
    regla = regla.when((negrita | (escala >= 1.15)) & (F.length(texto) < 150) & (filas <= 2) & ~texto.rlike(NUMERACION), "encabezado")
    regla = regla.when(texto.rlike(DISPLAY), "formula_display").when((F.length(texto) < 200) & texto.rlike(SIMBOLOS), "formula_inline").otherwise("parrafo")
    return F.coalesce(F.when(F.coalesce(recortar(texto), F.lit("")) == "", "ruido"), F.when(palabra, inicio), regla)


def cuantas(c: Column, signo: str) -> Column:
    """Occurrences of a one-character sign."""
    return F.length(c) - F.length(F.replace(c, F.lit(signo), F.lit("")))


def normalizar_latex(c: Column) -> Column:
    """Equivalent commands to one form, repeated thin spaces collapsed, needless elastic delimiters and index spaces removed."""
    r = c
    for viejo, nuevo in EQUIVALENCIAS:
        r = F.regexp_replace(r, viejo.replace("\\", r"\\") + "(?![A-Za-z])", nuevo.replace("\\", r"\\"))
    for e in (",", ";", ":"):
        r = F.regexp_replace(r, rf"(?:\\{e}){{2,}}", rf"\\{e}")
    r = F.regexp_replace(r, r"\\left\(([^()]{0,29})\\right\)", "($1)")
    r = F.regexp_replace(F.regexp_replace(r, r"\^(?U:\s)+", "^"), r"_(?U:\s)+", "_")
    return F.when(F.coalesce(recortar(c), F.lit("")) == "", c).otherwise(r)


def reparar_pares(c: Column, abre: str, cierra: str) -> Column:
    """Balance a pair of signs by count: missing closers at the end, missing openers in front."""
    d = cuantas(c, abre) - cuantas(c, cierra)
    return F.when(d > 0, F.concat(c, F.repeat(F.lit(cierra), d))).when(d < 0, F.concat(F.repeat(F.lit(abre), -d), c)).otherwise(c)


def reparacion_ambigua(c: Column) -> Column:
    """Does the repair have to guess?  More closing than opening signs, or an environment ended more often than begun."""
    mas = lambda a, b: cuantas(c, b) > cuantas(c, a)
    abre, cierra = (F.regexp_extract_all(c, F.lit(rf"\\{k}\{{([^}}]+)\}}"), F.lit(1)) for k in ("begin", "end"))
    sobra = F.exists(cierra, lambda x: F.size(F.filter(cierra, lambda y: y == x)) > F.size(F.filter(abre, lambda y: y == x)))
    return mas("{", "}") | mas("(", ")") | sobra


def reparar_entornos(c: Column) -> Column:
    """Append the missing ends of environments, in order of their beginnings."""
    abre = F.regexp_extract_all(c, F.lit(r"\\begin\{([^}]+)\}"), F.lit(1))
    cierra = F.regexp_extract_all(c, F.lit(r"\\end\{([^}]+)\}"), F.lit(1))
    # the k-th surplus beginning of a name is missing its end
    con = F.transform(abre, lambda x, i: F.struct(x.alias("n"), F.size(F.filter(F.slice(abre, 1, i + 1), lambda y: y == x)).alias("k")))
    faltan = F.filter(con, lambda x: x["k"] <= F.size(F.filter(abre, lambda y: y == x["n"])) - F.size(F.filter(cierra, lambda y: y == x["n"])))
    return F.concat(c, F.array_join(F.transform(faltan, lambda x: F.concat(F.lit("\n\\end{"), x["n"], F.lit("}"))), ""))


def reparar_estructura(c: Column) -> Column:
    return reparar_entornos(reparar_pares(reparar_pares(c, "{", "}"), "(", ")"))


def estructura_valida(c: Column) -> Column:
    """Braces and parentheses balance and never close before they open."""
    signos = F.split(F.regexp_replace(c, r"[^{}()]", ""), "")
    fin = F.aggregate(
        signos,
        F.struct(F.lit(0).alias("l"), F.lit(0).alias("p"), F.lit(True).alias("ok")),
        lambda a, x: F.struct(
            (a["l"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)).alias("l"),
            (a["p"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)).alias("p"),
            (a["ok"] & ~((x == "}") & (a["l"] <= 0)) & ~((x == ")") & (a["p"] <= 0))).alias("ok"),
        ),
        lambda a: a["ok"] & (a["l"] == 0) & (a["p"] == 0),
    )
    return fin


def puntaje_latex(c: Column) -> Column:
    """Structural score 0, 0.5 or 1 of a formula."""
    faltas = (
        F.when(cuantas(c, "{") != cuantas(c, "}"), 1.0).otherwise(0.0) + F.when(cuantas(c, "$") % 2 != 0, 1.0).otherwise(0.0)
        + F.when(cuantas(c, "(") != cuantas(c, ")"), 0.5).otherwise(0.0)
        + F.when(c.contains("\\\\") & c.endswith("\\") & ~c.endswith("\\\\"), 0.5).otherwise(0.0)
    )
    return F.when(F.coalesce(recortar(c), F.lit("")) == "", 0.0).when(faltas >= 2, 0.0).when(faltas >= 1, 0.5).otherwise(1.0)


def numero(c: Column) -> Column:
    """First hierarchical number of a text as integers, null without one; parts beyond 64 bits drop out."""
    n = F.nullif(F.regexp_extract(c, r"\d+(?:\.\d+)*", 0), F.lit(""))
    return F.filter(F.transform(F.split(n, r"\."), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def numero_corto(c: Column) -> Column:
    """First number of a text as it stands, two levels at most; null without one."""
    return F.nullif(F.regexp_extract(c, r"\d+(?:\.\d+)?", 0), F.lit(""))


def nivel_encabezado(c: Column) -> Column:
    n = F.regexp_extract(c, r"^(\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    return F.repeat(F.lit("#"), F.when(n == "", 2).otherwise(F.least(cuantas(n, ".") + 2, F.lit(6))))


def _lineas(c: Column) -> Column:
    return F.split(c, r"\r\n|\n|\r")


def como_lista(c: Column) -> Column:
    """One marked item per line; present markers stay."""
    items = F.filter(F.transform(_lineas(c), recortar), lambda x: x != "")
    sin = F.transform(items, lambda x: F.regexp_replace(x, r"^[•·]\s*", ""))
    return F.array_join(F.transform(sin, lambda x: F.when(x.rlike(r"^(?:[-*+]|\d+[.)])\s+"), x).otherwise(F.concat(F.lit("- "), x))), "\n")


def como_enunciado(c: Column) -> Column:
    et = F.regexp_extract(c, "(?iu)" + ENUNCIADO, 1)
    cuerpo = F.when(et == "", c).otherwise(recortar(F.concat(F.lit("**"), et, F.lit("** "), recortar(F.regexp_replace(c, "(?iu)" + ENUNCIADO, "")))))
    return F.array_join(F.transform(_lineas(cuerpo), lambda x: F.concat(F.lit("> "), x)), "\n")


def a_markdown(tipo: Column, texto: Column) -> Column:
    return (
        F.when(tipo == "encabezado", F.concat(nivel_encabezado(texto), F.lit(" "), texto))
        .when(tipo == "formula_display", F.concat(F.lit("$$\n"), texto, F.lit("\n$$")))
        .when(tipo == "codigo", F.concat(F.lit("```\n"), texto, F.lit("\n```")))
        .when(tipo == "lista", como_lista(texto))
        .when(tipo.isin("teorema", "lema", "proposicion", "definicion", "corolario", "demostracion"), como_enunciado(texto))
        .otherwise(texto)
    )


FORMULA = r"(\$\$[^$]*\$\$|\$[^$]+\$|\\\\\[.*?\\\\\])"


def segmentos_de_formula(c: Column) -> Column:
    """Alternating text and formula segments of a text, stripped, empty ones left out: array of (tipo, contenido).

    Formulas stand between dollars or between ``\\[`` and ``\\]`` with two backslashes each,
    as recognisers write them.  A text without any segment is one text segment.
    """
    marca = "\u0001"
    piezas = F.split(F.regexp_replace(c, FORMULA, f"{marca}$1{marca}"), marca)
    t = F.transform(piezas, lambda x, i: F.struct(F.when(i % 2 == 1, "formula_inline").otherwise("texto").alias("tipo"), recortar(x).alias("contenido")))
    t = F.filter(t, lambda x: x["contenido"] != "")
    return F.when(F.size(t) > 0, t).otherwise(F.array(F.struct(F.lit("texto").alias("tipo"), F.coalesce(c, F.lit("")).alias("contenido"))))


def objeto_json(c: Column) -> Column:
    """The text from the first opening to the last closing brace, null without both."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def sin_extension(titulo: Column) -> Column:
    """A title without what follows its last full stop; "documento" if nothing is left."""
    return primero_no_vacio(F.regexp_replace(titulo, r"(?s)\.[^.]*$", ""), F.lit("documento"))


def cabecera_de_descarga(nombre: Column) -> Column:
    """Content-Disposition with the name in ASCII ("_" for other signs) and percent-encoded."""
    ascii_ = F.replace(F.regexp_replace(nombre, r"[^\x00-\x7f]", "_"), F.lit("?"), F.lit("_"))
    codificado = F.replace(F.replace(F.url_encode(nombre), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit('attachment; filename="'), ascii_, F.lit("\"; filename*=UTF-8''"), F.replace(codificado, F.lit("%7E"), F.lit("~")))


def ngramas(palabras: Column, n: int) -> Column:
    k = F.size(palabras) - n + 1
    return F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(palabras, i, n), " "))).otherwise(F.array().cast("array<string>"))


def similitud(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty."""
    m = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / m)


def paginas(expresion: Column, total: Column) -> Column:
    """Page ranges such as "1-5, 8" to sorted distinct pages from 0.

    An empty expression means all pages; the upper end is cut to ``total``; null for an
    invalid range (no number, 0, reversed) or a page that does not exist.
    """
    partes = F.transform(F.split(expresion, ","), lambda x: F.trim(x))
    patron = r"^(\d{1,9})\s*(?:-\s*(\d{1,9}))?$"
    rangos = F.transform(
        partes,
        lambda x: F.struct(F.nullif(F.regexp_extract(x, patron, 1), F.lit("")).cast("int").alias("a"), F.coalesce(F.nullif(F.regexp_extract(x, patron, 2), F.lit("")), F.nullif(F.regexp_extract(x, patron, 1), F.lit(""))).cast("int").alias("b")),
    )
    mal = F.exists(rangos, lambda r: r["a"].isNull() | (r["a"] < 1) | (r["b"] < r["a"]) | (r["a"] > total))
    lista = F.array_sort(F.array_distinct(F.flatten(F.transform(rangos, lambda r: F.sequence(r["a"] - 1, F.least(r["b"], total) - 1)))))
    vacia = F.trim(F.coalesce(expresion, F.lit(""))) == ""
    return F.when(vacia, F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))).when(mal, None).otherwise(lista)
