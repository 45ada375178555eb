import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.llm import components, names, near_dup, neighbours

DOC = "row_id bigint, title string, content string, rep bigint, text string"


def triples(title, content):
    w = re.findall(r"[^\W_]+", f"{title or ''}\n{content}".lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(40, 160))]
        for edits in (0, 0, 2, 5, 9, 14):
            text = list(base)
            for _ in range(edits):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, rng.choice([None, "título"]) if edits else None, " ".join(text)))
            n += 1
    rows += [(n, "t", None), (n + 1, "t", ""), (n + 2, None, "dos palabras"), (n + 3, None, "dos palabras"), (n + 4, None, "a b c " * 20_000), (n + 5, None, "a b c " * 20_000), (None, None, "a b c d e f")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], DOC)
    sets = {r: triples(t, c) for r, t, c in rows if r is not None and c}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = [tuple(r) for r in near_dup.pairs_of_rows(docs).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)
    groups = {r["row_id"]: r for r in near_dup.groups_of_rows(docs).collect()}
    assert set(groups) == set(sets) and all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in got)
    assert near_dup.pairs_of_rows(docs.limit(0)).count() == 0 and near_dup.groups_of_rows(docs.limit(0)).count() == 0


def test_odd_sketch_estimate(spark):
    a, b = near_dup._coefficients()
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        x = rng.integers(0, 2**63, 600, dtype=np.uint64)
        common = int(round(600 * 2 * share / (1 + share)))
        y = np.concatenate((x[:common], rng.integers(0, 2**63, 600 - common, dtype=np.uint64)))
        s = [near_dup.odd_sketch(near_dup.minhash(v, a, b)).tolist() for v in (x, y)]
        df = spark.createDataFrame([tuple(s)], "a array<bigint>, b array<bigint>")
        assert df.select(near_dup.estimate(F.col("a"), F.col("b"))).first()[0] == pytest.approx(share, abs=0.12)
    assert near_dup.expected_recall(0.6) > 0.99


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 200)} == {100} and len(got) == 44


def store(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, rep int, ids int")


def best(rows, top=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -9)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -row))[: min(top, len(ids) - 1)]] for i, row in zip(ids, sims, strict=True)}


def test_neighbours_small_and_dirty(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(25)] + [(200, rows[1][1])]
    rows += [(300, None), (301, [0.0] * 64), (302, [1.0] * 63), (303, [float("nan")] + [1.0] * 63), (304, [float("inf")] + [1.0] * 63), (305, [None] + [1.0] * 63), (None, [1.0] * 64)]
    want = best(rows)
    got: dict[int, set] = {}
    for r in neighbours.neighbour_lists(store(spark, rows)).collect():
        got.setdefault(r["vec_id"], set()).add(r["other"])
    assert got.keys() == want.keys()
    hits = sum(len(got[i] & set(want[i])) for i in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert got[0] == set(want[0]) and got[110] == set(want[110])  # among copies the smaller ids win
    assert neighbours.neighbour_pairs(store(spark, rows[:1])).count() == 0
    assert neighbours.neighbour_pairs(store(spark, [(1, None)])).count() == 0


def test_neighbours_recall_over_many_ranges(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 64))
    rows = [(i, (centres[i % 300] + 0.25 * rng.normal(size=64)).tolist()) for i in range(6000)]
    want = best(rows)
    vectors = store(spark, rows).select("vec_id", "embedding")
    got = {r["vec_id"]: set(r["ids"]) for r in neighbours.nearest(vectors, window=128, block=512).collect()}
    assert len(got) == 6000
    assert sum(len(got[i] & set(want[i])) for i in want) >= 0.9 * 10 * len(want)


def test_neighbours_that_the_windows_miss(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    rows = [(i, (centres[i % 60] + 0.5 * rng.normal(size=64)).tolist()) for i in range(3000)]
    want = best(rows)
    vectors = store(spark, rows)
    few = {r["vec_id"]: set(r["ids"]) for r in neighbours.nearest(vectors.select("vec_id", "embedding"), window=2, block=32).collect()}
    assert sum(len(few[i] & set(want[i])) for i in want) < 0.8 * 10 * len(want)
    got: dict[int, set] = {i: set() for i in want}
    for r in neighbours.neighbour_lists(vectors, window=2, block=32).collect():
        got[r["vec_id"]].add(r["other"])
    assert all(len(x) == 10 for x in got.values())
    assert sum(len(got[i] & set(want[i])) for i in want) >= 0.9 * 10 * len(want)


def test_hilbert_keys_are_a_continuous_walk():
    for dims, depth in ((2, 3), (3, 2)):
        side = 1 << depth
        cells = np.array(list(itertools.product(range(side), repeat=dims)), dtype=np.uint64)
        keys = neighbours.hilbert_keys(cells, depth)
        assert sorted(keys.tolist()) == list(range(side**dims))
        walk = cells[np.argsort(keys)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def linked(spark, listed):
    df = spark.createDataFrame([(n, 1, "x") for n in listed], "name string, entity int, word string")
    return {tuple(r) for r in names.variant_pairs(df).collect()}


def test_names(spark):
    groups = [
        ["Graciela Narzotiñate Bermeja", "GRACIELA NARZOTIÑATE BERMEJA", "Graciela  Narzotiñate-Bermeja", "Por Graciela Narzotiñate Bermeja", "narzotinate bermeja, chela", "G. Narzotiñate", "@gnarzotinate",
         "Gracirla Narzotiñate", "Graciela Narzotiñate/Mundo Arvel", "Lic. Graciela Raúl Narzotiñate Bermeja", "Graciela Narzotiñate B.", "Narzotiñate Bermeja Graciela", "Graciela Nazrotiñate"],
        ["Enrique Cinflacastía Cantúa", "cinflacastia cantua, quique"], ["Enrique Cinflacastía Valcor", "Enrique Cinflacastía Valcor"],
        ["Raúl Arbizosque Valcor", "Arbizosque, Raúl"], ["Leonardo Arbizosque", "L. Arbizosque Valcor"], ["Andrés Izsumañate Hontín", "A. Izsumañate"], ["Ángela Izsumañate Hontín", "Izsumañate, Á."],
        ["Agencia Lumbre de Noticias", "Agencia Lumbre", "Ag. Lumbre Noticias", "Agencia Lumbre de Noticias (ALN)", "ALN", "Ajencia Lumbre"], ["Servicio Informativo Corval", "Corval, Servicio Informativo", "SICorval", "servicio informatvo corval"],
        ["Red Austral de Prensa"], ["Cinflacastía"], ["x" * 5000],
    ]
    listed = [n for g in groups for n in g]
    got = linked(spark, listed * 2 + [None, "", "  ", " "])
    want = {(a, b) if a < b else (b, a) for g in groups for a, b in itertools.combinations(g, 2)}
    assert got - want == set() and want - got == set()
    assert names.variant_pairs(spark.createDataFrame([], "name string")).count() == 0


def test_a_familiar_form_that_no_list_has_is_learned(spark):
    families = ["Olmedo Zarqui", "Tarnés Ubrique", "Corval Brumal", "Lindes Arvel", "Cantúa Hontín"]
    listed = [f"{g} {f}" for f in families for g in ("Graciela", "Xalita")] + ["Yarelo Olmedo Zarqui", "Xandrina Tarnés Ubrique"]
    got = linked(spark, listed)
    assert got == {(f"Graciela {f}", f"Xalita {f}") for f in families}


def test_edit_metric():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(50)]
    d = names.pivot_distances(words, words[:10])
    assert all(d[i, j] == names.damerau(w, words[j]) for i, w in enumerate(words) for j in range(10))
    assert names.damerau("ca", "abc") == 2
    for a, b, c in itertools.product(words[:14], repeat=3):
        assert names.damerau(a, c) <= names.damerau(a, b) + names.damerau(b, c)


def test_metric_cells_miss_no_pair(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(400)})
    want = {(a, b) for a in words for b in words if a != b and names.damerau(a, b) <= 1}
    got = {tuple(r) for r in names.close_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == want


def test_metric_cells_at_two_edits_and_in_parts(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(250)}
    words |= {("ab" * 40)[:n] for n in range(45, 53)} | {"q" * 3000, "q" * 2999 + "r", "q" * 1500 + "zq" + "q" * 1497}
    words = sorted(words)
    short = [w for w in words if len(w) < 100]
    want = {(a, b) for a in short for b in short if a != b and names.damerau(a, b) <= 2}
    want |= {(a, b) for a in words for b in words if a != b and len(a) > 100 and len(b) > 100 and a[0] == b[0] == "q" and sum(x != y for x, y in zip(a, b, strict=False)) <= 2 and abs(len(a) - len(b)) < 2}
    df = spark.createDataFrame([(w,) for w in words + ["", None]], "word string")
    assert {tuple(r) for r in names.close_words(df, 2, 20).collect()} == want
    assert names.close_words(df.limit(0)).count() == 0


def test_banded_distance_agrees_with_the_metric(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(names, "LONG_WORD", 0)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        for radius in (0, 1, 2, 3):
            assert names.within(a, b, radius) == (names.damerau(a, b) <= radius), (a, b, radius)
