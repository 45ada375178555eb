import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.config import Settings
from tamiz.operators import dense, fallback, hybrid, index, sparse
from tamiz.plans.engine import Engine

PLAIN = Settings(analyzer="simple")
DOCS = [("d1", "a a b"), ("d2", "b c"), ("d3", "c c c d")]


def build(spark, docs=DOCS, settings=PLAIN):
    rows = [(i, i, "", c, "s") for i, c in docs]
    return index.build_index(spark.createDataFrame(rows, "doc_id string, url string, title string, content string, source string"), settings)


def ask(spark, *texts, k=10):
    return spark.createDataFrame([(i, t, k) for i, t in enumerate(texts)], "query_id bigint, q string, k int")


@pytest.mark.parametrize("q, want", [
    ("a", {"d1": (-1.447459, 0.0)}), ("a b", {"d1": (-2.937078, 100.0), "d2": (-3.003743, 0.0)}),
    ("b b", {"d1": (-2.979239, 0.0), "d2": (-2.959726, 100.0)}), ("a zzz", {"d1": (-1e9, 0.0)}), ("   ", {}), ("zzz", {}),
])
def test_language_model(spark, q, want):
    got = {r["doc_id"]: (r["log_score"], r["score"]) for r in sparse.ranked(build(spark), ask(spark, q), PLAIN).collect()}
    assert got.keys() == want.keys()
    for d in want:
        assert got[d] == pytest.approx(want[d], abs=1e-5)


def test_skipping_unknown_terms(spark):
    got = sparse.ranked(build(spark), ask(spark, "a zzz"), PLAIN, oov="skip").first()
    assert got["log_score"] == pytest.approx(-1.447459, abs=1e-5)


def test_empty_documents_and_collections(spark):
    found = build(spark, [("x", ""), ("y", None), ("z", "a")])
    assert {r["doc_id"]: r["dl"] for r in found.doc_stats.collect()} == {"x": 0, "y": 0, "z": 1}
    assert found.corpus_stats.first()["n_docs"] == 3
    nothing = build(spark, [])
    assert nothing.corpus_stats.first()["avg_dl"] == 0.0
    assert sparse.search(nothing, ask(spark, "a"), PLAIN).count() == 0


def test_candidate_cap_and_ties(spark):
    found = build(spark, [(f"d{i:02}", "w v") for i in range(9)])
    got = sparse.candidates(found, ask(spark, "w"), Settings(analyzer="simple", top_candidates=4)).collect()
    assert sorted(r["doc_id"] for r in got) == ["d00", "d01", "d02", "d03"]


def test_explain_and_stats(spark, tmp_path):
    found = build(spark).save(str(tmp_path / "ix"))
    row = sparse.explain(found, ask(spark, "a b"), PLAIN).where("doc_id = 'd1'").first()
    assert [t["term"] for t in row["terms"]] == ["a", "b"] and row["dl"] == 3
    terms = spark.createDataFrame([("c",), ("zzz",)], "term string")
    got = {r["term"]: (r["cf"], r["df"]) for r in index.term_statistics(found, terms).collect()}
    assert got == {"c": (4, 2), "zzz": (0, 0)}
    tf = {r["doc_id"]: r["tf"] for r in index.term_frequency(found, found.doc_stats, "a", "simple").collect()}
    assert tf == {"d1": 2, "d2": 0, "d3": 0}


def test_upsert_and_delete(spark):
    schema = "url string, title string, n int"
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema)
    new = spark.createDataFrame([("a", "2", 2), ("a", "3", 3), ("c", "1", 1)], schema)
    got = index.upsert(old, new, "url", "n")
    assert {(r["url"], r["title"]) for r in got.collect()} == {("a", "3"), ("b", "1"), ("c", "1")}
    again = index.upsert(got, new, "url", "n")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert {r["url"] for r in index.delete_by_key(got, new).collect()} == {"b"}


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(80, None), (81, [0.0] * 8), (82, [1.0]), (83, [float("nan")] * 8), (84, x[3].tolist())]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    asked = df.where("id in (3, 7)").select(F.col("id").alias("query_id"), "embedding")
    for metric in ("l2", "cosine"):
        got = dense.knn(df, asked, 5, metric).collect()
        y = np.vstack([x, x[3]]).astype(float)
        ids = np.r_[np.arange(80), 84]
        for q in (3, 7):
            d = ((y - x[q].astype(float)) ** 2).sum(1) if metric == "l2" else 1 - y @ x[q] / (np.linalg.norm(y, axis=1) * np.linalg.norm(x[q].astype(float)))
            if metric == "l2":
                d, names = np.r_[d, (x[q].astype(float) ** 2).sum()], np.r_[ids, 81]
            else:
                names = ids
            want = names[np.lexsort((names, np.round(d, 9)))][:5].tolist()
            assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert dense.knn(df.limit(0), asked, 5).count() == 0
    assert dense.knn(df, asked.limit(0), 5).count() == 0


def test_vector_store_keeps_old_rows(spark):
    have = spark.createDataFrame([("a", 1)], "id string, n int")
    got = dense.add_vectors(have, spark.createDataFrame([("a", 2), ("b", 2), ("b", 2)], "id string, n int"))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]


def test_where_filter(spark):
    df = spark.createDataFrame([(1, "x"), (5, "y"), (9, "x")], "n int, s string")
    got = lambda spec: [r["n"] for r in df.where(dense.where_filter(spec)).orderBy("n").collect()]
    assert got({"s": "x"}) == [1, 9]
    assert got({"$and": [{"n": {"$gte": 5}}, {"s": {"$ne": "x"}}]}) == [5]
    assert got({"$or": [{"n": {"$in": [1]}}, {"n": {"$gt": 5}}]}) == [1, 9]
    assert got({"n": {"$nin": [1], "$lt": 9, "$lte": 5}}) == [5]


def test_rrf(spark):
    left = spark.createDataFrame([(1, "s1", 1), (1, "s2", 2), (1, "x", 3)], "query_id bigint, id string, rank int")
    right = spark.createDataFrame([(1, "d1", 1, "s2"), (1, "d2", 2, "s2"), (1, "x", 3, "x")], "query_id bigint, id string, rank int, doc_id string")
    got = [(r["id"], round(r["rrf_score"], 8)) for r in hybrid.fuse(left, right).orderBy("rank").collect()]
    assert got == [("x", round(2 / 63, 8)), ("s1", 0.01639344), ("d1", 0.01639344), ("s2", 0.01612903), ("d2", 0.01612903)]
    by_doc = hybrid.fuse(left, right, fuse_on="doc").orderBy("rank").first()
    assert by_doc["id"] == "s2" and by_doc["rrf_score"] == pytest.approx(1 / 62 + 1 / 61)


def test_fallback(spark):
    asked = ask(spark, "none", "some")
    local = spark.createDataFrame([(1, 1, "u1", "t", "s", 50.0, ""), (1, 2, "u1", "t", "s", 50.0, ""), (1, 3, "", "t", "s", 50.0, "")], "query_id bigint, rank int, url string, title string, source string, score double, snippet string")
    feed = spark.createDataFrame([(q, p, link, "t", "x" * 300, "f") for q in (0, 1) for p, link in enumerate(["w1", "w1", "u1", "w2"])], "query_id bigint, position int, link string, title string, summary string, source string")
    got = fallback.search_with_fallback(asked, local, feed, Settings()).orderBy("query_id", "position").collect()
    assert [(r["query_id"], r["url"], r["origin"]) for r in got] == [(0, "w1", "web"), (0, "u1", "web"), (0, "w2", "web"), (1, "u1", "local"), (1, "u1", "local")]
    assert got[0]["triggered"] and not got[-1]["triggered"] and len(got[0]["snippet"]) == 200


def test_engine_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame(
        [("s", "u1", "Economía", "La economía cubana crece. El turismo también.", ["A"], None), ("s", "u2", None, "Medicina y tecnología digital.", None, None)],
        "source string, url string, title string, content string, authors array<string>, date timestamp",
    )
    engine = Engine(spark)
    engine.index_documents(docs, str(tmp_path / "ix"))
    assert engine.index_vectors(docs, str(tmp_path / "vec")) == 2
    assert engine.sparse("economía cubana").first()["url"] == "u1"
    assert engine.dense("medicina tecnología", 1).first()["url"] == "u2"
    assert engine.dense("medicina", 5, {"title": "Economía"}).count() == 1
    fused = engine.hybrid("economía").orderBy("rank").collect()
    assert fused[0]["id"] == "u1" and any(r["score"] is None for r in fused)
    engine.index_documents(docs.where("url = 'u1'").withColumn("content", F.lit("otra cosa")), str(tmp_path / "ix"))
    assert engine.count() == 2 and engine.sparse("cubana").count() == 0
    engine.delete(spark.createDataFrame([("u2",)], "doc_id string"), str(tmp_path / "ix"))
    assert engine.count() == 1
    assert engine.suggestions("economía cubana").first()["key_terms"] == ["economía", "cubana"]
    assert engine.statistics().first()["mu"] == 100.0
