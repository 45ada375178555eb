"""Spellings of one journalist's or agency's name, linked.

A string is first read as a byline: credits, titles and outlets go, and what is
left becomes given name, first and second surname (each may be an initial or
missing), or the words of an organisation. The vocabulary of all name words is
joined with itself under a true edit metric (unrestricted Damerau-Levenshtein)
by metric-space partitioning: a word's home is the ring of its nearest pivot at
its distance from it; as an onlooker it goes to each ring of each pivot that the
triangle inequality cannot rule out. Inside a cell, the distances to all pivots
rule out nearly all pairs, and the metric itself decides on the rest. With the
misspelt words resolved that way, shortened names join the one full name of
their surname that they fit; a name that fits several stays on its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, release

FEWEST_PIVOTS, MOST_PIVOTS = 4, 48  # between them, half the root of the vocabulary
PIVOT_SAMPLE = 2000  # words, at most, among which the pivots are chosen
RADIUS = 1
LONG_WORD = 48  # characters; longer words have the empty word as their pivot, whose rings are the lengths
CELL = 4096  # words, at most, whose home is one task's part of a cell
RARE_STRINGS = 2  # a surname that no more strings have may be a misspelling of a commoner neighbour
FAMILIES, TOGETHER = 4, 0.8  # pairs of surnames, at least, and share of them, that a given name has in common with its full form
COMMONER = 12  # and so may one whose neighbour has so many times as many strings

# Spanish given names, each followed by its familiar forms.
GIVEN = """
adela, adolfo fito, adrian, agustin, alba, alberto beto albertito, alejandra ale sandra, alejandro ale jandro alex, alfonso poncho, alfredo fredo,
alicia licha, alonso, alvaro, amalia, amelia, ana anita, andrea, andres andresito, angel angelito, angela angelita, angelica, antonia tona,
antonio tono toni, armando, arturo, aurora, beatriz bea bety betty, benito, bernardo, blanca, camila cami, carlos carlitos charly, carlota, carmen carmela,
carolina caro, catalina cata, cecilia ceci, celia, cesar, clara, claudia, claudio, concepcion concha conchita, consuelo chelo, cristina cris cristi,
cristobal, daniel dani, daniela dani, david, diana, diego, dolores lola loli lolita, domingo, edgar, eduardo edu lalo, elena nena, elisa, elvira,
emilia emi, emilio milo, enrique quique kike, ernesto neto, esteban, ester, eugenia, eva, fabian, fatima, federico fede, felipe, felix, fernanda fer,
fernando nando fer, florencia flor, francisca paca, francisco paco pancho curro, gabriel gabo, gabriela gabi gaby, gerardo, gilberto, gloria,
gonzalo, graciela chela, gregorio goyo, guadalupe lupe lupita, guillermo memo guille, gustavo gus, hector, hernan, hilda, horacio, hugo,
ignacio nacho, ines inesita, irene, isabel chabela isa, ismael, ivan, jacinto, jaime, javier javi, jesus chucho chuy, joaquin quino, jorge, jose pepe, josefa pepa,
josefina, juan juanito, juana juanita, julia, julian, julio, laura, leonardo leo, leonor, leticia lety, lorena, lorenzo, lourdes, lucas, lucia luci, luis lucho,
luisa, manuel manolo manu, marcela, marcelo, marcos, margarita, maria mari, mariana, mario, marta, martin, mateo, mercedes meche merche, miguel, milagros mili mila,
monica, natalia, nicolas nico, noelia noe, norma, olga, oscar, pablo, patricia pati patty, paula, pedro perico, pilar, rafael rafa, ramon moncho, raquel, raul, rebeca, renata,
ricardo, roberto, rocio, rodrigo, rosa rosita, rosario charo, ruben, salvador, samuel, santiago santi, sara, sebastian seba sebas, sergio, silvia,
sofia, soledad sole, susana, teresa tere, tomas, valentin, valentina vale, valeria, vanesa, veronica vero, vicente, victor, victoria vicky, violeta, viviana, ximena, yolanda
"""

# Titles before a name.
TITLES = "dr dra dres ing lic licda prof profa profesor profesora sr sra srta don dona arq mtro mtra fray padre"

# Credits before a name.
CREDITS = "por texto escribe redaccion foto fotos fotografia informa"

# Words of organisations' names, each followed by its short forms.
ORGANISATION = """
agencia ag agcia, asociacion asoc, boletin bol, centro, colectivo, comite, consejo, cooperativa coop, corresponsalia, diario, editorial edit, equipo,
federacion fed, fundacion fund fundac, gaceta, grupo, instituto inst, magazine, medios, multimedios, noticias not notic, noticiero, observatorio obs, oficina, organizacion org,
periodico, prensa, radio, red, redaccion, revista rev, semanario sem, servicio serv, servicios, sindicato, television tv, informativo inf informat, informativos, comunicacion com
"""

_SMALL = frozenset("de del la el los las y e en a c s l".split())


def _pairs(table: str) -> dict[str, tuple[str, ...]]:
    """Short form -> the full forms it may stand for; every full form stands for itself."""
    out: dict[str, list[str]] = {}
    for entry in table.replace("\n", " ").split(","):
        full, *short = entry.split()
        for word in (full, *short):
            out.setdefault(word, []).append(full)
    return {w: (w,) if w in fulls else tuple(fulls) for w, fulls in out.items()}


NAMES = _pairs(GIVEN)
ORG_WORDS = _pairs(ORGANISATION)
_ORG_FULL = frozenset(w for full in ORG_WORDS.values() for w in full if len(w) > 5)

# Given names that are written with an accent on their first letter, and that letter.
ACCENTED = {"angel": "á", "angela": "á", "angeles": "á", "alvaro": "á", "oscar": "ó", "ursula": "ú", "edgar": "é", "erika": "é"}


def fold(text: str) -> str:
    """Small letters without accents; blanks of any kind as one space."""
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return " ".join(text.lower().split())


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertions, deletions, substitutions and swaps of neighbours
    cost 1 each, and a swapped pair may be edited again, which keeps the triangle inequality."""
    if a == b:
        return 0
    far = len(a) + len(b)
    last: dict[str, int] = {}
    table = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    for j in range(len(b) + 1):
        table[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                cost, seen = 0, j
            else:
                cost = 1
            table[i + 1][j + 1] = min(table[i][j] + cost, table[i + 1][j] + 1, table[i][j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return table[len(a) + 1][len(b) + 1]


def within(a: str, b: str, radius: int) -> bool:
    """``damerau(a, b) <= radius``, in time proportional to the length: cells off the diagonal by more are over it."""
    if abs(len(a) - len(b)) > radius:
        return False
    if max(len(a), len(b)) <= LONG_WORD:
        return damerau(a, b) <= radius
    far = radius + 1
    last: dict[str, int] = {}
    rows: dict[int, dict[int, int]] = {0: {j: j for j in range(min(len(b), radius) + 1)}}
    for i, x in enumerate(a, 1):
        row: dict[int, int] = {0: i} if i <= radius else {}
        seen = b.rfind(x, 0, max(0, i - radius - 1)) + 1
        for j in range(max(1, i - radius), min(len(b), i + radius) + 1):
            k, m = last.get(b[j - 1], 0), seen
            if x == b[j - 1]:
                cost, seen = 0, j
            else:
                cost = 1
            best = min(rows[i - 1].get(j - 1, far) + cost, rows[i - 1].get(j, far) + 1, row.get(j - 1, far) + 1)
            if k and m and k - 1 in rows:
                best = min(best, rows[k - 1].get(m - 1, far) + (i - k - 1) + 1 + (j - m - 1))
            row[j] = min(best, far)
        last[x] = i
        rows[i] = row
        rows.pop(i - 2 * radius - 3, None)  # a swap over so many letters costs more than the radius
        if min(row.values(), default=far) > radius:
            return False
    return rows[len(a)].get(len(b), far) <= radius


def pivot_distances(words: list[str], pivots: list[str]) -> np.ndarray:
    """``damerau`` of every word to every pivot, all words of a block at once."""
    width = max((len(w) for w in words), default=0)
    codes = np.zeros((len(words), max(width, 1)), np.int32)
    for i, w in enumerate(words):
        codes[i, : len(w)] = [ord(c) for c in w]
    lengths = np.array([len(w) for w in words])
    out = np.zeros((len(words), len(pivots)), np.int16)
    rows = np.arange(len(words))
    for p, pivot in enumerate(pivots):
        far = width + len(pivot) + 1
        # row i + 1 belongs to the pivot's i-th letter; row 0 and column 0 are the border
        table = np.full((len(pivot) + 2, width + 2, len(words)), far, np.int32)
        table[1, 1:, :] = np.arange(width + 1)[:, None]
        for i in range(len(pivot) + 1):
            table[i + 1, 1] = i
        for i, x in enumerate(pivot, 1):
            seen = np.zeros(len(words), np.int32)  # last column whose letter is x
            for j in range(1, width + 1):
                y = codes[:, j - 1]
                same = y == ord(x)
                best = np.minimum(table[i, j] + ~same, np.minimum(table[i + 1, j], table[i, j + 1]) + 1)
                # the last earlier row whose letter is y
                k = np.zeros(len(words), np.int32)
                for r in range(1, i):
                    k = np.where(y == ord(pivot[r - 1]), r, k)
                swap = table[k, seen, rows] + (i - k - 1) + 1 + (j - seen - 1)
                best = np.minimum(best, np.where((k > 0) & (seen > 0), swap, far))
                table[i + 1, j + 1] = best
                seen = np.where(same, j, seen)
        out[:, p] = table[len(pivot) + 1, lengths + 1, rows]
    return out


def choose_pivots(words: list[str], count: int = MOST_PIVOTS) -> list[str]:
    """Far-apart words of a bounded sample: each next one is farthest from those chosen."""
    words = sorted(set(words))
    if len(words) <= count:
        return words
    chosen = [words[0]]
    near = pivot_distances(words, chosen)[:, 0]
    while len(chosen) < count:
        chosen.append(words[int(near.argmax())])
        near = np.minimum(near, pivot_distances(words, chosen[-1:])[:, 0])
    return chosen


def _rings(words: list[str], pivots: list[str], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, pivot, ring, whether it is the word's home, distances to all pivots) of every cell that each of
    ``words`` goes to; the empty word is the pivot of number -1."""
    d = np.zeros((len(words), len(pivots)), np.int16)
    lengths = np.array([len(w) for w in words])
    short = np.flatnonzero(lengths <= LONG_WORD)
    d[short] = pivot_distances([words[i] for i in short], pivots)
    at, pivot, ring, home = [], [], [], []

    def go(i, p, r, own):
        at.append(i), pivot.append(p), ring.append(r), home.append(own)

    nearest = d.argmin(1)
    for shift in range(-radius, radius + 1):
        # x lives in ring d(x, p) of its nearest p; if d(x, y) <= r, then d(y, p) is within r of that, and
        # d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2r for y's own pivot q
        i, p = np.nonzero(d[short] <= d[short].min(1, keepdims=True) + 2 * radius)
        i = short[i]
        go(i, p, d[i, p] + shift, (p == nearest[i]) & (shift == 0))
        i = np.flatnonzero(lengths > LONG_WORD - radius)
        go(i, np.full(len(i), -1), lengths[i] + shift, (lengths[i] > LONG_WORD) & (shift == 0))
    at, pivot, ring, home = (np.concatenate(x) for x in (at, pivot, ring, home))
    return at, pivot, ring, home, d[at]


def close_words(vocabulary: DataFrame, radius: int = RADIUS, most: int = CELL) -> DataFrame:
    """(word, other): all ordered pairs of different words of ``vocabulary`` (word) within edit distance ``radius``.

    Every pair meets where one of the two has its home. A cell of more than ``most`` home words is cut into parts by a
    hash, each of which its onlookers visit; the cells' sizes, some hundreds of numbers, are all the driver gets.
    """
    spark = vocabulary.sparkSession
    words = cut(vocabulary.where(F.length("word") > 0).select("word").distinct(), "words")
    count = words.count()
    sample = [r["word"] for r in words.where(F.length("word") <= LONG_WORD).orderBy(F.xxhash64("word")).limit(PIVOT_SAMPLE).collect()]
    pivots = choose_pivots(sample, max(FEWEST_PIVOTS, min(MOST_PIVOTS, int(count**0.5 / 2)))) or ["a"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            listed = list(batch["word"])
            for i in range(0, len(listed), 5000):
                block = listed[i : i + 5000]
                at, pivot, ring, home, d = _rings(block, pivots, radius)
                yield pd.DataFrame({"word": [block[a] for a in at], "pivot": pivot, "ring": ring, "home": home, "far": [x.astype("<i2").tobytes() for x in d]})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        found = set()
        listed, home = frame["word"].to_numpy(), np.flatnonzero(frame["home"].to_numpy())
        far = np.frombuffer(b"".join(frame["far"]), "<i2").reshape(len(frame), -1)
        lengths = np.array([len(w) for w in listed])
        for i in range(0, len(home), 64):
            own = home[i : i + 64]
            near = np.abs(lengths[own][:, None] - lengths) <= radius
            for p in range(far.shape[1] if frame["pivot"].iloc[0] >= 0 else 0):  # long words have none
                near &= np.abs(far[own, p][:, None] - far[:, p]) <= radius
            for a, b in zip(*np.nonzero(near), strict=True):
                x, y = listed[own[a]], listed[b]
                if x != y and (x, y) not in found and within(x, y, radius):
                    found |= {(x, y), (y, x)}
        return pd.DataFrame(sorted(found), columns=["word", "other"])

    placed = cut(words.mapInPandas(place, "word STRING, pivot INT, ring INT, home BOOLEAN, far BINARY"), "cells")
    sizes = placed.where("home").groupBy("pivot", "ring").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return spark.createDataFrame([], "word STRING, other STRING")
    parts = spark.createDataFrame([(r["pivot"], r["ring"], -(-r["n"] // most)) for r in sizes], "c_pivot INT, c_ring INT, parts INT")
    placed = placed.join(F.broadcast(parts), (F.col("pivot") == F.col("c_pivot")) & (F.col("ring") == F.col("c_ring")))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    placed = placed.withColumn("part", F.explode(F.when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    # home words look on in the other parts of their cell
    guests = placed.where("home").withColumn("guest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(F.col("guest") != F.col("part"))
    guests = guests.select("word", "pivot", "ring", F.lit(False).alias("home"), "far", F.col("guest").alias("part"))
    placed = placed.select("word", "pivot", "ring", "home", "far", "part").unionByName(guests)
    return placed.groupBy("pivot", "ring", "part").applyInPandas(meet, "word STRING, other STRING").distinct()


_ACCENT = re.compile(r"(?<!\w)[ÁÉÍÓÚáéíóú](?!\w)")

PARSED = "name STRING, kind STRING, given STRING, s1 STRING, s2 STRING, words ARRAY<STRING>"


def _is_given(word: str) -> bool:
    return word in NAMES or len(word) > 3 and any(w in NAMES for w in _one_edit(word))


def _one_edit(word: str) -> set[str]:
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in parts if b}
    out |= {a + b[1] + b[0] + b[2:] for a, b in parts if len(b) > 1}
    out |= {a + c + b[1:] for a, b in parts if b for c in letters}
    return out | {a + c + b for a, b in parts for c in letters}


def read_name(name: str) -> tuple[str, str, str, str, list[str]]:
    """(kind, given, first surname, second surname, words): kind is ``person``, ``org`` or ``none``.

    Initials come out as one letter; a missing part as ''. Account names (@ and an initial with a surname)
    are persons with an initial.
    """
    text = fold(name)
    text = re.sub(r"\s*/.*$", "", text)
    account = re.match(r"^@([a-z])([a-z]{3,})\d*$", text)
    if account:
        return "person", account[1], account[2], "", []
    text = re.sub(rf"^(?:{'|'.join(CREDITS.split())})\s*:?\s+", "", text)
    words = re.findall(r"[^\W_]+", text)
    if not words:
        return "none", "", "", "", []
    bare = [w for w in words if w not in _SMALL]
    if any(w not in NAMES and (w in ORG_WORDS or len(w) > 5 and not _ORG_FULL.isdisjoint(_one_edit(w))) for w in bare) or (len(words) == 1 and name.strip().isupper() and 2 <= len(words[0]) <= 5) or re.fullmatch(r"(?:[a-z]\. ?){2,5}", text):
        if re.fullmatch(r"(?:[a-z]\. ?){2,5}", text):
            bare = ["".join(words)]
        return "org", "", "", "", bare or words
    before, comma, after = text.partition(",")
    title = re.compile(rf"^(?:(?:{'|'.join(TITLES.split())})\.?\s+)+")
    left, right = (re.findall(r"[^\W_]+", title.sub("", part.strip())) for part in (before, after))
    if comma and right:
        given, family = right, left
    else:
        words = left
        if len(words) == 1:
            return "person", "", words[0], "", []
        if len(words) >= 3 and not _is_given(words[0]) and len(words[0]) > 1 and _is_given(words[-1]):
            turn = len(words) - 1
            while turn > 1 and turn > len(words) - 2 and words[turn - 1] in NAMES:
                turn -= 1
            given, family = words[turn:], words[:turn]
        else:
            n = 1
            while n < len(words) - 1 and n < 3 and (words[n] in NAMES or len(words[n]) == 1 or n + 2 < len(words) and _is_given(words[n])):
                n += 1
            given, family = words[:n], words[n:]
    if not family:
        return "person", "", given[-1], "", []
    first = given[0] if given else ""
    if len(first) == 2 and first not in NAMES and len(given) == 1:
        first = first[0]  # two initials written together
    if len(first) == 1:
        accent = _ACCENT.search(unicodedata.normalize("NFC", name))
        if accent and fold(accent[0]) == first:
            first = accent[0].lower()
    small = [w for w in family if w not in ("de", "del", "la", "los", "las")] or family
    return "person", first, small[0], small[1] if len(small) > 1 else "", []


def parse_names(names: DataFrame) -> DataFrame:
    """Distinct non-blank strings of ``names`` (name), read by ``read_name``."""
    distinct = names.where(F.col("name").isNotNull() & F.col("name").rlike(r"(?U)[^\s\x{1c}-\x{1f}]")).select("name").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, *read_name(n)) for n in batch["name"]]
            yield pd.DataFrame(rows, columns=["name", "kind", "given", "s1", "s2", "words"])

    return distinct.mapInPandas(run, PARSED)


def _lexicon(spark: SparkSession) -> DataFrame:
    """(word, full): every known given name or familiar form, and the names it may stand for. A fixed table."""
    return spark.createDataFrame([(w, f) for w, fulls in NAMES.items() for f in fulls], "lex STRING, full STRING")


def _learned(people: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lex, full): given names that no list knows, and the one known name beside whose strings they stand.

    A familiar form shows with the same two surnames as its full form, again and again; relatives share theirs once. A
    family's strings count once a given name; only known full names are joined, so a family gives few rows a name.
    """
    families = people.where((F.length("given") > 1) & (F.length("s2") > 1)).select("given", "s1", "s2").distinct()
    odd = families.join(F.broadcast(lexicon.select("lex").distinct()), F.col("given") == F.col("lex"), "left_anti")
    full = families.join(F.broadcast(lexicon.where(F.col("lex") == F.col("full"))), F.col("given") == F.col("lex")).select("s1", "s2", "full")
    met = odd.join(full, ["s1", "s2"]).groupBy("given", "full").agg(F.count("*").alias("n"))
    total = odd.groupBy(F.col("given").alias("t_given")).agg(F.count("*").alias("total"))
    close = met.join(total, F.col("given") == F.col("t_given")).where((F.col("n") >= FAMILIES) & (F.col("n") >= TOGETHER * F.col("total")))
    best = close.groupBy("given").agg(F.max(F.struct("n", "full")).alias("best"))
    return best.select(F.col("given").alias("lex"), F.col("best.full").alias("full"))


def _resolve_given(people: DataFrame, near: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add ``g``: the given name in full; an initial, an unknown name and '' stay as they are.

    A form that may stand for several names (or a misspelling near several) takes the one that another
    string with the same first surname has in full, if there is just one such.
    """
    words = people.where(F.length("given") > 1).select("given").distinct()
    known = words.join(F.broadcast(lexicon), F.col("given") == F.col("lex")).select("given", "full")
    unknown = words.join(F.broadcast(lexicon.select("lex").distinct()), F.col("given") == F.col("lex"), "left_anti")
    guessed = unknown.join(near, F.col("given") == F.col("word")).join(F.broadcast(lexicon), F.col("other") == F.col("lex")).select("given", "full").distinct()
    options = known.unionByName(guessed)
    sure = people.where(F.length("given") > 1).join(F.broadcast(lexicon), (F.col("given") == F.col("lex")) & (F.col("lex") == F.col("full")))
    sure = sure.select(F.col("s1").alias("k_s1"), F.col("full").alias("k_full")).distinct().withColumn("seen", F.lit(1))
    named = people.where(F.length("given") > 1).select("given", "s1").distinct()
    tried = named.join(options.withColumnRenamed("given", "o_given"), F.col("given") == F.col("o_given"))
    tried = tried.join(sure, (F.col("s1") == F.col("k_s1")) & (F.col("full") == F.col("k_full")), "left")
    chosen = tried.groupBy("given", "s1").agg(
        F.count("*").alias("n"), F.count("seen").alias("n_seen"), F.min("full").alias("any"), F.min(F.when(F.col("seen") == 1, F.col("full"))).alias("one")
    )
    g = F.when(F.col("n_seen") == 1, F.col("one")).when(F.col("n") == 1, F.col("any"))
    chosen = chosen.select(F.col("given").alias("c_given"), F.col("s1").alias("c_s1"), g.alias("g"))
    joined = people.join(chosen, (F.col("given") == F.col("c_given")) & (F.col("s1") == F.col("c_s1")), "left").drop("c_given", "c_s1")
    return joined.withColumn("g", F.coalesce("g", "given"))


def _fits(a: Column, b: Column) -> Column:
    """Two parts of a name can be the same: equal, one missing, or one the other's initial."""
    short = lambda x, y: (F.length(x) == 1) & y.startswith(x)
    return (a == b) | (a == "") | (b == "") | short(a, b) | short(b, a)


def _offered(part: Column) -> Column:
    """Keys under which a part of a name is found: itself, its initial with a mark, and any."""
    return F.when(part == "", F.array(part, F.lit("*"))).otherwise(F.array(part, F.concat(F.substring(part, 1, 1), F.lit("*")), F.lit("*")))


def _sought(part: Column) -> Column:
    """Keys by which ``part`` finds all parts that it fits, each by one of them: an equi-join in place of ``_fits``."""
    initial = F.array(F.lit(""), F.concat(part, F.lit("*")))
    return F.when(part == "", F.array(F.lit("*"))).when(F.length(part) == 1, initial).otherwise(F.array(part, F.substring(part, 1, 1), F.lit("")))


def _resolve_surnames(people: DataFrame, near: DataFrame) -> DataFrame:
    """Put the usual spelling for a misspelt first or second surname.

    ``s1``: few strings have it, more have a neighbour of it, and one of those fits in given name and
    second surname. ``s2``: as common a neighbour stands beside the same given name and first surname.
    """
    counts = cut(people.groupBy("s1").agg(F.count("*").alias("n")), "surnames")
    own = counts.withColumnRenamed("n", "r_n")
    pairs = own.join(near, F.col("s1") == F.col("word")).select(F.col("s1").alias("old"), "r_n", F.col("other").alias("s1")).join(counts.withColumnRenamed("n", "o_n"), "s1")
    fewer = (F.col("o_n") > F.col("r_n")) | ((F.col("o_n") == F.col("r_n")) & (F.col("s1") < F.col("old")))
    pairs = pairs.where(((F.col("r_n") <= RARE_STRINGS) & fewer) | (F.col("o_n") >= COMMONER * F.col("r_n")))
    steps = people.select("name", F.col("s1").alias("old"), F.col("g").alias("r_g"), F.col("s2").alias("r_s2")).where(F.col("r_g") != "").join(pairs, "old")
    # a people's keys stand once each, however many have the surname
    host = people.select("s1", (F.length("g") > 1).alias("h_full"), F.explode(_offered(F.col("g"))).alias("g_key"), "s2").distinct()
    host = host.select("s1", "g_key", "h_full", F.explode(_offered(F.col("s2"))).alias("s2_key")).groupBy("s1", "g_key", "s2_key").agg(F.max("h_full").alias("h_full"))
    steps = steps.withColumn("g_key", F.explode(_sought(F.col("r_g")))).withColumn("s2_key", F.explode(_sought(F.col("r_s2"))))
    fit = steps.join(host, ["s1", "g_key", "s2_key"])
    full = (F.length("r_g") > 1) & F.col("h_full")
    best = fit.groupBy("name").agg(F.max(F.struct(full.cast("int").alias("full"), "o_n", "s1")).alias("best")).select(F.col("name").alias("b_name"), F.col("best.s1").alias("new"))
    people = people.join(best, F.col("name") == F.col("b_name"), "left").withColumn("s1", F.coalesce("new", "s1")).drop("b_name", "new")
    people = cut(people, "people")
    common = cut(people.where(F.length("s2") > 1).groupBy("s2").agg(F.count("*").alias("n")), "seconds")
    pairs = people.where(F.length("s2") > 1).select("g", "s1", "s2").distinct().join(common, "s2")
    steps = pairs.join(near, F.col("s2") == F.col("word")).select("g", "s1", F.col("s2").alias("old"), F.col("other").alias("s2"), F.col("n").alias("old_n"))
    new = steps.join(common.withColumnRenamed("n", "new_n"), "s2").where((F.col("new_n") > F.col("old_n")) | ((F.col("new_n") == F.col("old_n")) & (F.col("s2") < F.col("old"))))
    beside = people.where(F.length("s2") > 1).select(F.col("s1").alias("e_s1"), F.col("s2").alias("e_s2")).distinct()
    new = new.join(beside, (F.col("s1") == F.col("e_s1")) & (F.col("s2") == F.col("e_s2")), "left")
    score = F.max(F.struct(F.col("e_s1").isNotNull().cast("int").alias("beside"), "new_n", "s2"))
    new = new.groupBy("g", "s1", "old").agg(score.alias("best")).select(F.col("g").alias("n_g"), F.col("s1").alias("n_s1"), F.col("old").alias("n_s2"), F.col("best.s2").alias("new"))
    match = (F.col("g") == F.col("n_g")) & (F.col("s1") == F.col("n_s1")) & (F.col("s2") == F.col("n_s2"))
    return people.join(new, match, "left").withColumn("s2", F.coalesce("new", "s2")).drop("n_g", "n_s1", "n_s2", "new")


def _near_given(people: DataFrame, near: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A given name that no list knows takes its neighbour's spelling beside the same first surname."""
    plain = people.where(F.length("g") > 1).groupBy("s1", "g").agg(F.count("*").alias("n"))
    odd = plain.join(F.broadcast(lexicon.select("lex").distinct()), F.col("g") == F.col("lex"), "left_anti")
    steps = odd.join(near, F.col("g") == F.col("word")).select("s1", F.col("g").alias("old"), F.col("other").alias("g"), F.col("n").alias("old_n"))
    met = steps.join(plain, ["s1", "g"]).where((F.col("n") > F.col("old_n")) | ((F.col("n") == F.col("old_n")) & (F.col("g") < F.col("old"))))
    new = met.groupBy("s1", "old").agg(F.max(F.struct("n", "g")).alias("best")).select(F.col("s1").alias("n_s1"), F.col("old").alias("n_g"), F.col("best.g").alias("new"))
    return people.join(new, (F.col("s1") == F.col("n_s1")) & (F.col("g") == F.col("n_g")), "left").withColumn("g", F.coalesce("new", "g")).drop("n_s1", "n_g", "new")


def _settle(keys: DataFrame) -> DataFrame:
    """(g, s1, s2, entity): every distinct name key's entity.

    Full names are entities. A name without its second surname joins the one full name it fits, else
    is an entity itself; then one with initials joins the one entity of its surname that it fits.
    """
    name = F.concat_ws("|", "g", "s1", "s2")
    full = cut(keys.where((F.length("g") > 1) & (F.length("s2") > 1)).select("g", "s1", "s2"), "full")
    fulls = full.groupBy("g", "s1").agg(F.count("*").alias("n"), F.min("s2").alias("only"), F.collect_set(F.substring("s2", 1, 1)).alias("initials"))
    short = keys.where((F.length("g") > 1) & (F.length("s2") <= 1)).join(fulls, ["g", "s1"], "left")
    by_initial = full.groupBy("g", "s1", F.substring("s2", 1, 1).alias("s2")).agg(F.count("*").alias("n_i"), F.min("s2").alias("only_i"))
    by_initial = by_initial.select(F.col("g").alias("i_g"), F.col("s1").alias("i_s1"), F.col("s2").alias("i_s2"), "n_i", "only_i")
    short = short.join(by_initial, (F.col("g") == F.col("i_g")) & (F.col("s1") == F.col("i_s1")) & (F.col("s2") == F.col("i_s2")), "left")
    to = F.when((F.col("s2") == "") & (F.col("n") == 1), F.col("only")).when(F.col("n_i") == 1, F.col("only_i"))
    alone = F.when((F.col("s2") != "") & F.col("n").isNotNull(), F.col("s2")).otherwise(F.lit(""))
    short = short.select("g", "s1", "s2", F.concat_ws("|", "g", "s1", F.coalesce(to, alone)).alias("entity"))
    settled = cut(full.withColumn("entity", name).unionByName(short), "settled")
    # initials: entities of the surname whose given name starts so
    accents = F.create_map(*[F.lit(x) for pair in ACCENTED.items() for x in pair])
    accent = F.try_element_at(accents, F.col("g"))
    have = settled.select("s1", F.substring("g", 1, 1).alias("i"), accent.alias("i_accent"), "entity").distinct()
    have = have.withColumn("e_s2", F.element_at(F.split("entity", r"\|"), 3))
    starts = F.array_distinct(F.array_compact(F.array(F.lit(""), "i", "i_accent")))
    have = have.select("s1", "entity", "e_s2", F.col("i_accent").isNull().alias("plain"), F.explode(starts).alias("g"))
    # of several, an initial without an accent is first of all that of a name without one; entities are counted by key
    # before initials meet them
    plain = F.when(F.col("plain"), F.col("entity"))
    keyed = have.withColumn("s2_key", F.explode(_offered(F.col("e_s2")))).groupBy("s1", "g", "s2_key")
    keyed = keyed.agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("only"), F.count(plain).alias("n_p"), F.min(plain).alias("only_p"))
    initial = keys.where(F.length("g") <= 1)
    asked = initial.select("g", "s1", "s2", F.explode(_sought(F.col("s2"))).alias("s2_key"))
    exact = (F.length("s2") > 1) & (F.col("s2_key") == F.col("s2"))
    fit = asked.join(keyed, ["s1", "g", "s2_key"]).groupBy("g", "s1", "s2")
    fit = fit.agg(F.sum("n").alias("n"), F.min("only").alias("only"), F.coalesce(F.sum(F.when(exact, F.col("n"))), F.lit(0)).alias("n_x"), F.min(F.when(exact, F.col("only"))).alias("only_x"), F.sum("n_p").alias("n_p"), F.min("only_p").alias("only_p"))
    pick = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_x") == 1, F.col("only_x")).when((F.col("g") != "") & (F.col("n_p") == 1), F.col("only_p"))
    rest = initial.join(fit, ["g", "s1", "s2"], "left").select("g", "s1", "s2", F.when(F.col("s1") != "", pick).alias("entity"))
    linked = rest.where(F.col("entity").isNotNull())
    # initials without a full name: the longest of one (initial, surname) gathers those it fits
    left = rest.where(F.col("entity").isNull()).select("g", "s1", "s2")
    second = left.where(F.length("s2") > 1).groupBy("g", "s1").agg(F.count("*").alias("n"), F.min("s2").alias("only"))
    left = left.join(second, ["g", "s1"], "left")
    part = F.when(F.length("s2") > 1, F.col("s2")).when((F.col("n") == 1) & _fits(F.col("s2"), F.col("only")), F.col("only")).otherwise(F.col("s2"))
    left = left.select("g", "s1", "s2", F.concat_ws("|", "g", "s1", part).alias("entity"))
    return settled.unionByName(linked).unionByName(left)


def _organisations(parsed: DataFrame, near: DataFrame) -> DataFrame:
    """(name, entity) of organisations: the same distinctive words, and the general ones of one within the other's."""
    spark = parsed.sparkSession
    orgs = parsed.where(F.col("kind") == "org").select("name", F.posexplode("words").alias("i", "w"))
    general = spark.createDataFrame([(s, f[0]) for s, f in ORG_WORDS.items()], "short STRING, long STRING")
    orgs = orgs.join(F.broadcast(general), F.col("w") == F.col("short"), "left").withColumn("w", F.coalesce("long", "w")).withColumn("general", F.col("long").isNotNull()).drop("short", "long")
    counts = cut(orgs.groupBy("w").agg(F.count("*").alias("n"), F.max("general").alias("is_general")), "org_words")
    steps = counts.where((F.length("w") > 3) & ~F.col("is_general")).join(near, F.col("w") == F.col("word")).select(F.col("w").alias("old"), F.col("n").alias("old_n"), F.col("other").alias("w"))
    better = steps.join(counts, "w").where((F.col("n") > F.col("old_n")) | F.col("is_general"))
    better = better.groupBy("old").agg(F.max(F.struct("n", "w", "is_general")).alias("best")).select("old", F.col("best.w").alias("new"), F.col("best.is_general").alias("new_general"))
    orgs = orgs.join(better, F.col("w") == F.col("old"), "left").select("name", "i", F.coalesce("new", "w").alias("w"), (F.col("general") | F.coalesce("new_general", F.lit(False))).alias("general"))
    rows = orgs.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("i", "w", "general"))).alias("ws"))
    words = F.transform("ws", lambda x: x["w"])
    initials = F.array_join(F.transform("ws", lambda x: F.substring(x["w"], 1, 1)), "")
    # an acronym beside the words it stands for says nothing new
    own = F.filter("ws", lambda x: ~((F.length(x["w"]) <= 4) & (F.length(x["w"]) == F.size("ws") - 1) & ~x["general"] & (F.size("ws") > 2)))
    rows = rows.select("name", own.alias("ws"), words.alias("all"), initials.alias("initials"))
    mark = F.array_join(F.sort_array(F.array_distinct(F.transform(F.filter("ws", lambda x: ~x["general"]), lambda x: x["w"]))), " ")
    kinds = F.sort_array(F.array_distinct(F.transform(F.filter("ws", lambda x: x["general"]), lambda x: x["w"])))
    rows = rows.select("name", mark.alias("mark"), kinds.alias("kinds"), F.array_join(F.sort_array(kinds), " ").alias("kind_key"), F.array_join(F.transform("ws", lambda x: F.substring(x["w"], 1, 1)), "").alias("initials"))
    rows = cut(rows, "orgs")
    keys = rows.select("mark", "kinds", "kind_key", "initials").distinct()
    # by mark: the widest set of general words takes every set within it; sets apart stay apart
    widest = keys.groupBy("mark").agg(F.max(F.struct(F.size("kinds").alias("n"), F.col("kind_key").alias("k"), F.col("kinds").alias("kinds"))).alias("top"))
    keys = keys.join(widest, "mark").withColumn("inside", F.size(F.array_except("kinds", "top.kinds")) == 0)
    keyed = keys.select("mark", "kind_key", F.concat_ws("|", F.lit("org"), "mark", F.when(F.col("inside"), F.col("top.k")).otherwise(F.col("kind_key"))).alias("entity")).distinct()
    out = rows.join(keyed, ["mark", "kind_key"])
    # an acronym alone joins the one organisation with such initials
    wide = out.where((F.size("kinds") > 0) & (F.length("initials") >= 2)).select(F.col("initials").alias("a"), "entity").distinct()
    one = wide.groupBy("a").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("full")).where(F.col("n") == 1).select("a", "full")
    out = out.join(one, (F.size("kinds") == 0) & (F.col("mark") == F.col("a")), "left")
    return out.select("name", F.coalesce("full", "entity").alias("entity"))


def _run_together(lone: DataFrame, parsed: DataFrame, organisations: DataFrame) -> DataFrame:
    """(name, entity) of single words (name, s1) that are one organisation's words without the blanks: the
    first two or more of them, the leading ones perhaps as initials."""

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for words, entity in zip(batch["words"], batch["entity"], strict=True):
                words = [ORG_WORDS.get(w, (w,))[0] for w in words]
                for m in range(2, len(words) + 1):
                    for k in range(m):
                        rows.add(("".join(w[0] for w in words[:k]) + "".join(words[k:m]), entity))
            yield pd.DataFrame(sorted(rows), columns=["form", "entity"])

    known = parsed.where(F.col("kind") == "org").select("name", "words").join(organisations, "name").select("words", "entity").distinct()
    made = known.mapInPandas(forms, "form STRING, entity STRING").groupBy("form").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("entity"))
    return lone.join(made.where((F.col("n") == 1) & (F.length("form") > 5)), F.col("s1") == F.col("form")).select("name", "entity")


def entities(names: DataFrame) -> DataFrame:
    """(name, entity) of every distinct non-blank string of ``names`` (name), exactly as stored.

    NULL and blank strings give no rows, repeated strings one. ``entity`` is a readable key; strings
    that fit several people equally have one of their own.
    """
    spark = names.sparkSession
    parsed = cut(parse_names(names), "parsed")
    lexicon = _lexicon(spark)
    parts = F.filter(F.concat(F.array("given", "s1", "s2"), F.coalesce("words", F.array().cast("array<string>"))), lambda w: F.length(w) > 2)
    vocabulary = parsed.select(F.explode(parts).alias("word")).unionByName(lexicon.select(F.col("lex").alias("word"))).distinct()
    vocabulary = vocabulary.unionByName(spark.createDataFrame([(w,) for w in ORG_WORDS], "word STRING"))
    near = cut(close_words(vocabulary), "near")
    release(spark)  # the driver holds the plans and broadcasts of all these small steps
    people = parsed.where(F.col("kind") == "person").select("name", "given", "s1", "s2")
    lexicon = lexicon.unionByName(cut(_learned(people, lexicon), "learned"))
    people = cut(_resolve_given(people, near, lexicon), "people")
    people = _resolve_surnames(people, near)
    people = cut(_near_given(people, near, lexicon), "people")
    # a misspelt surname may have hidden the name that decides between two readings of a given name
    people = cut(_resolve_given(people.select("name", F.col("g").alias("given"), "s1", "s2"), near, lexicon), "people")
    release(spark)
    settled = cut(_settle(people.select("g", "s1", "s2").distinct()), "entities")
    linked = people.join(settled, ["g", "s1", "s2"]).select("name", "entity")
    organisations = cut(_organisations(parsed, near), "organisations")
    lone = people.where((F.col("g") == "") & (F.col("s2") == "")).select("name", "s1")
    joined = cut(_run_together(lone, parsed, organisations), "joined")
    return linked.join(joined.select("name"), "name", "left_anti").unionByName(joined).unionByName(organisations)


def variant_pairs(names: DataFrame) -> DataFrame:
    """(name_a, name_b): every pair of different strings with the same entity, in code point order."""
    found = cut(entities(names), "found")
    other = found.select(F.col("entity"), F.col("name").alias("name_b"))
    return found.withColumnRenamed("name", "name_a").join(other, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
