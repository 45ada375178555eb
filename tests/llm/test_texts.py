import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.llm import encoding, mixing, packing, splitting, tokens

TOKEN = re.compile(r"\w+|[^\w\s]")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1_,. \n¿«»é", max_size=400), st.integers(4, 40), st.integers(0, 3))
def test_pieces_tile_the_text(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
    assert all(a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False))
    for number, _, _, _, n, lap, piece in pieces:
        assert n == len(TOKEN.findall(piece)) <= limit
        assert lap == (overlap if number else 0)
    for a, b in zip(pieces, pieces[1:], strict=False):
        if overlap:
            assert TOKEN.findall(a[6])[-overlap:] == TOKEN.findall(b[6])[:overlap]


def test_natural_boundaries():
    text = "Uno dos tres.\n\nEl art. 4 del Sr. Paz sigue. Cinco seis siete ocho.\n\nNueve diez once doce trece."
    pieces = splitting.split_text(text, 22, 0)
    assert [p[6] for p in pieces] == [text[: text.index("\n\nNueve")], "Nueve diez once doce trece."]
    spans = [m.span() for m in TOKEN.finditer("art. 4 B. Ruiz dijo. Fin")]
    assert splitting.boundaries("art. 4 B. Ruiz dijo. Fin", spans).count(splitting.SENTENCE) == 1
    with pytest.raises(ValueError):
        splitting.split_text("a", 3, 3)


def test_split_items(spark):
    rows = [("a", "uno " * 50), ("a", "uno " * 50), ("b", "uno"), ("c", None), ("d", ""), ("e", "x" * 300_000 + " y" * 30), (None, "dos. " * 60)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "id string, content string, piece_no int, piece string")
    got = splitting.split_items(df, 20, 5).collect()
    assert {r["id"] for r in got} == {"a", "e", None} and all(r["n_tokens"] <= 20 for r in got)
    assert sorted(map(str, (r["id"] for r in splitting.oversized(df, 20, 5).collect()))) == ["None", "a", "e"]
    assert splitting.oversized(df.limit(0), 20, 5).count() == 0
    texts = ["ñu_1 a-b, c d ½ x́", "港口 a\x1cb"]
    counted = spark.createDataFrame([(t,) for t in texts], "t string").select(splitting.token_count(F.col("t"))).collect()
    assert [r[0] for r in counted] == [len(TOKEN.findall(t)) for t in texts]


def test_token_sizes_of_long_runs():
    assert tokens.count(None) == tokens.count("") == 0
    text = "hola " + "a" * 100_000 + " " * 9000 + "fin"
    assert 0 < tokens.count(text) < len(text)
    assert tokens.encoder(tokens.DEFAULT_VOCABULARY).decode(tokens.encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60))
def test_packing_bounds(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    bins = packing.best_fit_decreasing(sizes, 30)
    used = np.bincount(bins, weights=sizes) if len(sizes) else np.zeros(0)
    assert (used <= 30).all()
    bound = packing.lower_bound(sizes, 30)
    values, counts = np.unique(sizes, return_counts=True)
    assert bound <= max(1, len(used)) if len(sizes) else bound == 0
    assert packing.histogram_bound(values, counts, 30) <= (len(used) if len(sizes) else 0) or not sizes.any()
    assert packing.lower_bound(np.array([16] * 5), 30) == 5 and packing.lower_bound(np.array([11] * 6 + [20] * 2), 30) == 5


def test_containers(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["palabra"] * rng.randint(1, 400))) for i in range(300)] + [(900, None), (901, ""), (902, "largo " * 3000), (903, "largo " * 3000), (None, "x")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, part int")
    items = packing.measured_pieces(docs, 512)
    got = packing.pack(items, 512, partition_items=64).collect()
    assert len(got) == items.count() and len({(r["doc_id"], r["piece_no"]) for r in got}) == len(got)
    fill: dict = {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert r["n_pieces"] == 1 or r["doc_id"] in (902, 903)
    assert max(fill.values()) <= 512 and all(r["container_tokens"] == fill[r["container_id"]] for r in got)
    report = packing.packing_report(packing.pack(items, 512, partition_items=64), 512).first()
    assert report["lower_bound"] <= report["containers"] <= 1.1 * report["lower_bound"] + 2
    assert packing.pack(items.limit(0), 512).count() == 0
    assert packing.packing_report(packing.pack(items.limit(0), 512), 512).first()["containers"] == 0


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["casa", "plan", "mar"]) for _ in range(rng.randint(5, 60))) + f" {i}", "a" if i % 3 else "b") for i in range(900)]
    rows += [(2000 + i, rows[0][1], "a") for i in range(5)] + [(3000, None, "a"), (3001, "", "b"), (3002, "otra", "z"), (3003, "sin fuente", None), (None, "x", "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, slot int, k1 int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets).collect()
    uses: dict = {}
    for r in got:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
    by_source = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in "ab"}
    assert by_source["a"] / sum(by_source.values()) == pytest.approx(5 / 9, abs=0.02)
    assert all(uses.get(i, 0) <= 1 for i, _, s in rows if s == "a") and max(uses.values()) <= 3 and 3002 not in uses and not {2000, 2001} & set(uses)
    report = {r["source"]: r for r in mixing.share_report(mixing.mix(docs, targets), targets).collect()}
    assert report["c"]["actual_share"] == 0.0 and report["b"]["most_uses"] <= 3
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_schedule_is_even(spark):
    got = mixing.schedule(spark, [("a", 0.7), ("b", 0.3)], 1000).orderBy("slot").collect()
    seen = {"a": 0, "b": 0}
    for n, r in enumerate(got, 1):
        assert r["turn"] == seen[r["source"]]
        seen[r["source"]] += 1
        assert abs(seen["a"] - 0.7 * n) < 4


GOOD = [
    "La investigación económica presentó según lo previsto una región energética después de la visita al señor Núñez.", "¿Aprobó el comité público un análisis técnico? “Sí”, dijo la jueza – así fue, además.",
    "A situação econômica da região não mudou até agora, segundo o avô.", "La forêt près du château a été fermée à l’été, où le maître était âgé.",
]


def test_encoding_repair(spark):
    rng = random.Random(7)
    words = sorted({w for t in GOOD for w in t.split()})
    rows = [(i, f"s{i % 3}", " ".join(rng.choice(words) for _ in range(60))) for i in range(400)]
    broken = {}
    ways = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "mac_roman"), ("cp850", "latin-1"), ("cp1252", "cp1251")]
    for i in range(0, 70):
        written, read = ways[i % len(ways)]
        text = " ".join(rng.choice(GOOD[:1]) for _ in range(1)) + " " + GOOD[0]
        data = text.encode(written, "replace")
        bad = data.decode(read, "replace") if read != "cp1252" else "".join(encoding._table("cp1252")[0][b] for b in data)
        rows.append((1000 + i, f"s{i % 3}", bad))
        broken[1000 + i] = text
    twice = "".join(encoding._table("cp1252")[0][b] for b in "".join(encoding._table("cp1252")[0][b] for b in GOOD[0].encode()).encode())
    rows += [(2000, "s1", twice), (2001, "s1", "La situaci�n sigue"), (3000, "s0", None), (3001, None, ""), (3002, None, "solo ascii"), (3003, "s0", "Новости часа: сбор урожая."), (3004, "s1", "ÂNCORA · CORAÇÃO · RÊVE · NOËL"),
             (3005, "s0", "INVESTIGACIÓN ECONÓMICA &aacute; café"), (3006, "s2", "ñ" * 100_000), (None, "s0", "Ã³")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, source string, text string, chain string")
    found = {r["doc_id"] for r in encoding.garbled(docs).collect()}
    want = set(broken) | {2000, 2001}
    assert want <= found and not found - want
    fixed = {r["doc_id"]: r for r in encoding.restored(docs).collect()}
    right = sum(fixed[i]["text"] == t for i, t in broken.items())
    assert right >= 0.9 * len(broken) and fixed[2000]["text"] == GOOD[0] and not fixed[2001]["complete"]
    assert encoding.garbled(docs.limit(0)).count() == 0


def test_words_that_no_undoing_changes_are_told_by_form():
    rng = random.Random(4)
    for codec in encoding.READ_AS:
        chars, _ = encoding._table(codec)
        for _ in range(400):
            word = "".join(rng.choice(chars[0x80:] + ["a", "b", "Z", "-"]) for _ in range(rng.randint(1, 5)))
            assert encoding._undoes(codec).search(word) or encoding.undo_utf8(word, codec) == word
