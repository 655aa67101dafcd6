"""Noise of scanned pages: hyphens, misread characters, running headers and page numbers."""

from __future__ import annotations

import re
from collections.abc import Container, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.comun import TABLA_VISUAL, fijar, visual

# --- fixed values: what a recogniser writes, and what stood there -----------------------------
CONFUSIONES = [
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("h", "li"), ("li", "h"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"),
    ("b", "h"), ("h", "b"), ("1", "l"), ("1", "i"), ("1", "í"), ("l", "i"), ("i", "l"), ("0", "o"), ("0", "ó"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("6", "ó"), ("6", "é"), ("6", "o"), ("4", "a"), ("4", "á"), ("3", "e"),
    ("2", "z"), ("7", "t"), ("@", "a"), ("$", "s"), ("|", "l"), ("!", "i"), ("€", "e"),
]
# --- end of fixed values -----------------------------------------------------------------------
RAZON = 15  # a correction is at least so many times as frequent as what it corrects
TASA = 1e-6  # least share of all words of a word that may correct others
TASA_DIFUSION = 5e-6  # words from this share of all words on are broadcast; there are at most 200,000 of them
MIN_EVIDENCIA = 20  # uses of both halves that speak for a compound's own hyphen
MODULO = (1 << 61) - 1  # of the anagram hash
GUIONES = "-¬­‐‑"
_PARTIDA = re.compile(rf"([^\W\d_][^\s]*?)[{GUIONES}][ \t]*$")
_NUM = r"(?:\d{1,4}(?:\s*(?:/|de|of|von|sur)\s*\d{1,4})?|[ivxlc]{1,7})"
_FOLIO = re.compile(rf"^[-–—·•\[(|~ ]*(?:(?:p|pp|pág|pag|página|page|seite|s)\.?\s*)?{_NUM}[-–—·•\])|~ ]*$", re.I)
_CON_FOLIO = re.compile(rf"^(?:(?P<a>{_NUM})(?:\s{{2,}}|\s*[|·—–]\s*|\t)(?P<t1>\S.*)|(?P<t2>.*\S)(?:\s{{2,}}|\s*[|·—–]\s*|\t)(?P<b>{_NUM}))$")
_CAPITULO = re.compile(r"^(?:cap[íi]tulo|chapter|chapitre|kapitel|secci[óo]n|section|abschnitt|se[çc][ãa]o)\s+(?:\d+|[ivxlc]+)\b", re.I)
_TERMINAL = re.compile(r"[.!?∎][»”\"')\]]*$")
_FORMULA = re.compile(r"[=<>≤≥∈→‖∑∫|$\\^_{}²]|\d")
_PALABRA = re.compile(r"[^\W\d_]+")
_CORTE = re.compile(r"(?<=[.!?∎])\s+")
_PUNTO = re.compile(r"[.!?][»”\"')\]]*\s*∎?$")
_TROZO = re.compile(r"[^\s.,;:?«»“”()\[\]…\"]+")
_FILA = re.compile(r"\t|\|.*\||&.*&|;.*;")


def hay_oracion(t: str) -> bool:
    """At least one full sentence: four words or more up to a full stop."""
    return any(_PUNTO.search(f) and len(_PALABRA.findall(f)) >= 4 for f in _CORTE.split(t))


def _titulo(t: str) -> bool:
    """Could the line be a running title?"""
    p = _PALABRA.findall(t)
    return bool(p) and len(p) <= 8 and len(t) <= 60 and t[0].isupper() and not re.search(r"[.;,!?:]$", t) and not _FORMULA.search(_CAPITULO.sub("", t))


def lineas_de_pagina(lineas: list[str]) -> dict[int, str]:
    """Index of lines that belong to the page and not to the text → ``folio``, ``encabezado`` or ``ambos``.

    Paragraphs are filled line by line, so a line inside one that leaves room for the first
    word of the next line was put in.  At the edges and between such lines the form
    decides: bare page numbers, titles without a full stop, with or without a number.
    """
    n = len(lineas)
    ancho = max(map(len, lineas))
    salida: dict[int, str] = {}
    for i, cruda in enumerate(lineas):
        t = cruda.strip()
        if not t:
            continue
        if _FOLIO.match(t):
            # "x = \n30" ends like a number only at the end of a sentence
            if n > 1 and not (0 < i == n - 1 and re.search(r"[=<>+−≤≥(/]$|\b(?:k|n|capítulo|chapter|chapitre|kapitel|sección|section|abschnitt|seção|dimensión|dimension|dimensão)$", lineas[i - 1].strip(), re.I)):
                salida[i] = "folio"
            continue
        m = _CON_FOLIO.match(t)
        if m:
            titulo = (m["t1"] or m["t2"]).strip()
            if _titulo(titulo) and not _FILA.search(titulo):
                salida[i] = "ambos"
                continue
        if not _titulo(t) or _FILA.search(t):
            continue
        sig = next((lineas[j].strip() for j in range(i + 1, n) if lineas[j].strip() and j not in salida and not _FOLIO.match(lineas[j].strip())), "")
        ant = next((lineas[j].strip() for j in range(i - 1, -1, -1) if lineas[j].strip() and j not in salida), "")
        if n == 1 or not (sig or ant):
            continue
        if sig:
            cabe = len(t) + 1 + len(sig.split()[0]) <= ancho
            if t.isupper() and any(c.islower() for c in sig + ant):
                salida[i] = "encabezado"
            elif _CAPITULO.match(t) and cabe:
                salida[i] = "encabezado"
            elif cabe and len(t) <= 0.85 * ancho and (not ant or not sig[0].isupper() or _TERMINAL.search(ant) or not _TERMINAL.search(t)):
                salida[i] = "encabezado"
        elif ant and (t.isupper() and any(c.islower() for c in ant) or _TERMINAL.search(ant) or _CAPITULO.match(t) or len(t.split()) <= 4 and not t.endswith(tuple(GUIONES))):
            salida[i] = "encabezado"
    return salida


def analizar(texto: str, frecuentes: Mapping[str, int], claves: set[str] | None = None, comunes: Container[str] = ()) -> tuple[list[str], str, list[str]]:
    """``(defects, repaired text, words to look up)`` of one text.

    A word divided at a line end is joined without its hyphen unless the corpus has its
    parts with the hyphen within a line (a compound's own hyphen).  ``claves`` takes the
    words whose counts (``frecuentes``) decide, without hyphens: so they are the same however
    it decides.  Words to look up are those that are not ``comunes``.
    """
    s = re.sub(rf"[­‐‑](?=[ \t]*\n)", "¬", texto) if "\n" in texto else texto  # the visual form would drop these
    s = visual(s)
    lineas = s.split("\n")
    defectos: set[str] = set()
    if len(lineas) > 1:
        pagina = lineas_de_pagina(lineas)
        for k in pagina.values():
            defectos |= {"encabezado", "folio"} if k == "ambos" else {k}
        lineas = [x for i, x in enumerate(lineas) if i not in pagina]
    partes: list[str] = []  # lines, or what was joined of them
    for x in lineas:
        x = x.strip()
        if not x:
            continue
        antes = partes[-1] if partes else ""
        m = _PARTIDA.search(antes[max(antes.rfind(" "), antes.rfind("\t")) + 1 :]) if antes[-1:] and antes[-1] in GUIONES else None
        minuscula = x[0].islower()
        if not m or not (minuscula or (x[0].isupper() and antes.rsplit(None, 1)[-1].isupper())):
            partes.append(x)
            continue
        izq = (_TROZO.findall(m[1]) or [m[1]])[-1].lower()
        der = (_TROZO.findall(x) or [""])[0].lower()
        if claves is not None:
            claves |= {izq.replace("-", ""), der.replace("-", ""), (izq + der).replace("-", "")}
        junto, con_guion = frecuentes.get(izq + der, 0), frecuentes.get(f"{izq}-{der}", 0)
        propio = con_guion > junto or (minuscula and not junto and not con_guion and antes.endswith("-") and frecuentes.get(izq, 0) >= MIN_EVIDENCIA and frecuentes.get(der, 0) >= MIN_EVIDENCIA and len(izq) > 3 and len(der) > 3)
        if propio:
            partes[-1] = antes.rstrip(GUIONES) + "-" + x
        else:
            defectos.add("guion")
            partes[-1] = antes.rstrip(GUIONES) + x
    salida = " ".join(partes)
    raras = sorted({w for w in _TROZO.findall(salida.lower()) if 2 <= len(w) and w not in comunes and any(c.isalpha() for c in w) and "\\" not in w and "_" not in w})
    return sorted(defectos), salida, raras


def textos(bloques: DataFrame, ocr: DataFrame) -> DataFrame:
    """``(bloque_id, campo, texto)`` of both sources; null texts drop out."""
    b = bloques.where("id is not null and texto_plano is not null").select(F.col("id").alias("bloque_id"), F.lit("texto_plano").alias("campo"), F.col("texto_plano").alias("texto"))
    o = ocr.where("id is not null and contenido is not null").select(F.col("id").alias("bloque_id"), F.lit("contenido").alias("campo"), F.col("contenido").alias("texto"))
    return b.unionByName(o)


def vocabulario(textos_: DataFrame) -> DataFrame:
    """``(palabra, n)`` over all texts, line-end hyphens joined; partial counts combine before the shuffle."""
    de = "".join(chr(c) for c, v in TABLA_VISUAL.items() if c < 0x10000 and v and len(v) == 1 and v not in " \n")
    a = "".join(v for c, v in TABLA_VISUAL.items() if c < 0x10000 and v and len(v) == 1 and v not in " \n")
    fuera = "".join(chr(c) for c, v in TABLA_VISUAL.items() if c < 0x10000 and v is None and c != 0xAD)
    t = F.regexp_replace("texto", r"(?<=\p{L})[-¬­‐][ \t]*\n(?=\p{L})", "")
    t = F.lower(F.translate(t, de + fuera, a))
    w = F.explode(F.split(t, r"(?U)[\s.,;:?«»“”()\[\]…\"]+"))
    return textos_.select(w.alias("palabra")).where(r"char_length(palabra) >= 2 and palabra rlike '\\p{L}' and not palabra rlike '[\\\\_]'").groupBy("palabra").agg(F.count("*").alias("n"))


def _valor(s: str) -> int:
    return sum((ord(c) if ord(c) < 512 else 512 + ord(c) % 509) ** 5 for c in s)


def _anagrama(c):
    """Anagram hash: sum of the fifth powers of the character values, the same for any order of characters."""
    v = lambda x: F.when(x == "", 0).when(F.ascii(x) < 512, F.ascii(x)).otherwise(512 + F.ascii(x) % 509)
    return F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda a, x: F.pmod(a + F.pow(v(x).cast("double"), F.lit(5.0)).cast("bigint"), F.lit(MODULO)))


def _deshechas(forma: str, a: str, b: str) -> str:
    """SQL: the array of what ``forma`` becomes if ``b`` stands for ``a`` at one of its places."""
    return f"transform(filter(sequence(1, length({forma})), i -> substring({forma}, i, length({a})) = {a}), i -> concat(substring({forma}, 1, i - 1), {b}, substring({forma}, i + length({a}))))"


def correcciones(vocab: DataFrame) -> DataFrame:
    """``(palabra, correccion, pasos)``: rare words and the best frequent word that a confusion or two turns into them.

    A confusion changes the anagram hash by a fixed difference, two by the sum of theirs.
    The hash of a rare word plus each difference of a confusion whose characters the word
    holds (for the second: or may hold after the first) is joined with the hashes of the
    frequent words, on the hash alone.  Candidates are then verified: undoing the
    confusions at some places of the word has to give exactly the frequent one.  They rank
    by number of confusions, then frequency, then alphabet.  Two confusions in a word of
    four or five characters need the square of ``RAZON``; in fewer they tell nothing (any
    two words of three letters are two confusions apart).  Frequent is a word with at
    least ``RAZON`` times the uses of the rare one and the share ``TASA`` of all words, so the
    choice is the same at any size of corpus.  The table of confusions is a small literal.
    """
    total, mayor = vocab.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return vocab.sparkSession.createDataFrame([], "palabra string, correccion string, pasos int")
    f = vocab.where((F.col("n") >= max(RAZON, TASA * total)) & F.col("palabra").rlike(r"^[\p{L}\p{M}'’-]+$")).select(F.col("palabra").alias("correccion"), F.col("n").alias("nb"), _anagrama("palabra").alias("hash"))
    uno = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((_valor(b) - _valor(a)) % MODULO).alias("d")) for a, b in CONFUSIONES])
    r = vocab.where((F.col("n") * RAZON <= mayor) & F.col("palabra").rlike(r"^[\p{L}\p{M}\d@$|!€'’-]+$") & F.col("palabra").rlike(r"\p{L}"))
    r = r.select("palabra", "n", _anagrama("palabra").alias("h"), F.filter(uno, lambda c: F.contains(F.col("palabra"), c["a"])).alias("c1"))

    def hallar(x: DataFrame) -> DataFrame:
        return x.join(f, "hash").where(F.col("nb") >= RAZON * F.col("n"))

    p1 = r.withColumn("c", F.explode("c1")).select("palabra", "n", F.pmod(F.col("h") + F.col("c.d"), F.lit(MODULO)).alias("hash"), "c")
    j1 = hallar(p1).where(f"array_contains({_deshechas('palabra', 'c.a', 'c.b')}, correccion)").select("palabra", "correccion", F.lit(1).alias("pasos"), "nb").distinct()
    j1 = fijar(j1)
    # a second one: its characters stand in the word or come up where the first was undone
    resto = r.where("char_length(palabra) >= 4").join(j1.select("palabra").distinct(), "palabra", "left_anti").withColumn("c", F.explode("c1")).withColumn("k", F.explode(uno))
    surge = F.exists(F.split(F.col("k.a"), ""), lambda x: (x != "") & F.contains(F.col("c.b"), x))
    resto = resto.where(F.contains("palabra", F.col("k.a")) & (F.col("k.a") >= F.col("c.a")) | surge)
    p2 = resto.select("palabra", "n", F.pmod(F.col("h") + F.col("c.d") + F.col("k.d"), F.lit(MODULO)).alias("hash"), "c", "k")
    dos = f"exists({_deshechas('palabra', 'c.a', 'c.b')}, x -> array_contains({_deshechas('x', 'k.a', 'k.b').replace('i ->', 'j ->').replace(' i,', ' j,').replace(' i -', ' j -').replace(' i +', ' j +')}, correccion))"
    j2 = hallar(p2).where((F.char_length("palabra") >= 6) | (F.col("nb") >= RAZON**2 * F.col("n"))).where(dos).select("palabra", "correccion", F.lit(2).alias("pasos"), "nb").distinct()
    w = Window.partitionBy("palabra").orderBy("pasos", F.desc("nb"), "correccion")
    return j1.unionByName(j2).withColumn("k", F.row_number().over(w)).where("k = 1").select("palabra", "correccion", "pasos")


_PARTIDAS = r"[-¬\u00ad\u2010\u2011][ \t]*\n"


def _cuentas(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(bloque_id, campo, cuentas)``: corpus counts of the words that decide on a text's line-end hyphens."""

    def tarea(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lote in lotes:
            claves = []
            for t in lote.column(2).to_pylist():
                c: set[str] = set()
                analizar(t, {}, c)
                claves.append(sorted(c))
            yield pa.RecordBatch.from_arrays([lote.column(0), lote.column(1), pa.array(claves, pa.list_(pa.string()))], names=["bloque_id", "campo", "claves"])

    c = df.mapInArrow(tarea, "bloque_id string, campo string, claves array<string>").select("bloque_id", "campo", F.explode("claves").alias("clave")).distinct()
    v = vocab.select(F.replace("palabra", F.lit("-"), F.lit("")).alias("clave"), "palabra", "n").where("n > 1")
    return c.join(v, "clave").groupBy("bloque_id", "campo").agg(F.map_from_entries(F.collect_set(F.struct("palabra", "n"))).alias("cuentas"))


def analizados(df: DataFrame, vocab: DataFrame, con_texto: bool = False, tasa: float = TASA_DIFUSION) -> DataFrame:
    """``(bloque_id, campo, defectos, raras, oracion[, reparado])`` of ``df(bloque_id, campo, texto)``.

    ``vocab``: the counted words without those that have a correction.  Texts with a hyphen
    at a line end get the counts that decide on it by a join; the others are not shuffled.
    ``raras`` are the words of a text that may have a correction: those with a share of
    ``tasa`` or more of all words (at most 1 / tasa words, which are broadcast) have none.
    Empty texts have no defects.
    """
    total = vocab.agg(F.sum("n")).first()[0] or 0
    b = df.sparkSession.sparkContext.broadcast({r.palabra for r in vocab.where((F.col("n") >= tasa * total) & (F.col("n") >= RAZON)).select("palabra").collect()})
    partido = F.col("texto").rlike(_PARTIDAS)
    con = df.where(partido)
    con = con.join(_cuentas(con, vocab), ["bloque_id", "campo"], "left").select("bloque_id", "campo", "texto", "cuentas")
    todo = df.where(~partido).withColumn("cuentas", F.lit(None).cast("map<string,bigint>")).unionByName(con)

    def tarea(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comunes = b.value
        for lote in lotes:
            r = [analizar(t, dict(c) if c else {}, None, comunes) for t, c in zip(lote.column(2).to_pylist(), lote.column(3).to_pylist())]
            cols = [lote.column(0), lote.column(1), pa.array([x[0] for x in r], pa.list_(pa.string())), pa.array([x[2] for x in r], pa.list_(pa.string())), pa.array([hay_oracion(x[1]) for x in r])]
            nombres = ["bloque_id", "campo", "defectos", "raras", "oracion"]
            if con_texto:
                cols.append(pa.array([x[1] for x in r], pa.string()))
                nombres.append("reparado")
            yield pa.RecordBatch.from_arrays(cols, names=nombres)

    return todo.mapInArrow(tarea, "bloque_id string, campo string, defectos array<string>, raras array<string>, oracion boolean" + (", reparado string" if con_texto else ""))


def _escaneados(bloques: DataFrame) -> DataFrame:
    return bloques.where("origen_contenido = 'requiere_ocr' and id is not null").select(F.col("id").alias("bloque_id")).distinct()


def _por_revisar(bloques: DataFrame, ocr: DataFrame) -> DataFrame:
    """Texts of scanned blocks; of results all, since which block is scanned is known only after a join."""
    return textos(bloques.where("origen_contenido = 'requiere_ocr'"), ocr)


def defectos(bloques: DataFrame, ocr: DataFrame) -> DataFrame:
    """``(bloque_id, campo, defecto)`` of texts of scanned blocks with a full sentence, each defect once.

    ``guion``, ``encabezado`` and ``folio`` are seen within the text; ``caracter`` is a word
    with a ranked correction.  Word counts cover all texts of both tables.
    """
    vocab = fijar(vocabulario(textos(bloques, ocr)))
    cor = fijar(correcciones(vocab))
    a = fijar(analizados(_por_revisar(bloques, ocr), vocab.join(cor, "palabra", "left_anti")).where("oracion and (size(defectos) > 0 or size(raras) > 0)").drop("oracion"))
    lineas = a.select("bloque_id", "campo", F.explode("defectos").alias("defecto"))
    caracter = a.select("bloque_id", "campo", F.explode("raras").alias("palabra")).join(cor.select("palabra"), "palabra", "left_semi").select("bloque_id", "campo", F.lit("caracter").alias("defecto"))
    return lineas.unionByName(caracter).distinct().join(_escaneados(bloques), "bloque_id", "left_semi")


def reparados(bloques: DataFrame, ocr: DataFrame) -> DataFrame:
    """``(bloque_id, campo, texto)``: repaired continuous text of every text of a scanned block.

    Page lines are gone, divided words joined, corrected words replaced (initial capitals
    and capitals kept).  A text without defects comes out joined to one paragraph.  Texts delivered twice come out once; different
    texts under one id come out each.
    """
    vocab = fijar(vocabulario(textos(bloques, ocr)))
    cor = fijar(correcciones(vocab)).select("palabra", "correccion")
    a = fijar(analizados(_por_revisar(bloques, ocr), vocab.join(cor, "palabra", "left_anti"), con_texto=True).join(_escaneados(bloques), "bloque_id", "left_semi").select("bloque_id", "campo", "reparado", "raras").distinct())
    clave = F.xxhash64("reparado")
    m = a.select("bloque_id", "campo", clave.alias("h"), F.explode("raras").alias("palabra")).join(cor, "palabra")
    # a text's corrections are at most its own rare words
    m = m.groupBy("bloque_id", "campo", "h").agg(F.map_from_entries(F.collect_set(F.struct("palabra", "correccion"))).alias("mapa"))
    j = a.withColumn("h", clave).join(m, ["bloque_id", "campo", "h"], "left")

    def tarea(lotes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lote in lotes:
            salida = []
            for t, mapa in zip(lote.column(2).to_pylist(), lote.column(3).to_pylist()):
                d = dict(mapa or [])

                def pon(x, d=d):
                    w = x[0]
                    c = d.get(w.lower())
                    return w if c is None else c.upper() if w.isupper() and len(w) > 1 else c[0].upper() + c[1:] if w[0].isupper() else c

                salida.append(_TROZO.sub(pon, t) if d else t)
            yield pa.RecordBatch.from_arrays([lote.column(0), lote.column(1), pa.array(salida, pa.string())], names=["bloque_id", "campo", "texto"])

    return j.select("bloque_id", "campo", "reparado", "mapa").mapInArrow(tarea, "bloque_id string, campo string, texto string")
