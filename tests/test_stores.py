import gzip
import json
import threading
from datetime import datetime
from urllib.request import urlopen

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiz.config import Settings
from tamiz.operators import crawl, dense, index
from tamiz.plans import answers
from tamiz.plans.engine import Engine
from tamiz.sources import pages, web

DOC = "source string, url string, title string, content string, authors array<string>"


def rows(spark, *pairs):
    return spark.createDataFrame([("s", u, "", t, None) for u, t in pairs], DOC)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_last_row_of_a_url_wins_on_every_load(spark, tmp_path):
    path = str(tmp_path / "ix")
    listed = [(f"u{i}", f"texto {i}") for i in range(88)] + [(f"u{i}", f"corregido {i}") for i in range(6)]
    engine = Engine(spark)
    engine.index_documents(rows(spark, *listed), path)
    found = {r["doc_id"]: r["content"] for r in engine.index.docs.collect()}
    assert len(found) == 88 and all(found[f"u{i}"] == f"corregido {i}" for i in range(6))
    engine.index_documents(rows(spark, ("u9", "viejo"), ("u9", "nuevo"), (None, "sin url")), path)
    assert engine.count() == 88 and [r["id"] for r in engine.sparse("nuevo").collect()] == ["u9"] and engine.sparse("viejo").count() == 0
    # another engine goes on from the last commit
    again = Engine(spark).open(path)
    again.delete(spark.createDataFrame([("u9",), ("none",)], "doc_id string"), path)
    assert again.count() == 87 and engine.count() == 88 and engine.refresh().docs.count() == 87


def test_statistics_of_deltas_are_those_of_a_whole_build(spark, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "ix"))
    store.upsert(index.index_document(rows(spark, ("a", "energía acuerdo acuerdo"), ("b", "puente"), ("c", None))))
    store.upsert(index.index_document(rows(spark, ("a", "energía nueva"), ("d", ""))))
    store.delete(spark.createDataFrame([("b",), (None,)], "doc_id string"))
    store.upsert(index.index_document(rows(spark, ("b", "puente puente"))))
    want = index.build_index(index.index_document(rows(spark, ("a", "energía nueva"), ("b", "puente puente"), ("c", ""), ("d", ""))).withColumn("doc_id", F.col("url")))
    for _ in range(2):
        got = store.index()
        for name in ("postings", "doc_stats", "term_stats", "corpus_stats"):
            columns = getattr(want, name).columns
            same(getattr(got, name).select(columns), getattr(want, name))
        store.compact()
        assert len(store.kept.live()) == 1


def test_an_empty_store_and_a_failed_commit(spark, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "ix"))
    assert store.index().docs.count() == 0 and store.index().corpus_stats.first()["n_docs"] == 0
    store.kept.write(1, "docs", rows(spark, ("x", "y")))  # no manifest names it
    assert store.index().docs.count() == 0
    store.upsert(index.index_document(rows(spark)))
    assert store.index().docs.count() == 0
    with pytest.raises(RuntimeError):
        store.kept.commit(1, [1])


def test_vectors_added_deleted_and_added_again(spark, tmp_path):
    make = lambda *ids: spark.createDataFrame([(i, c, [1.0]) for i, c in ids], "id string, content string, embedding array<float>")
    store = dense.VectorStore(spark, str(tmp_path / "v"))
    assert store.count() == 0
    store.add(make(("a", "1"), ("a", "2"), ("b", "1"), (None, "0")))
    store.delete(spark.createDataFrame([("a",), ("z",)], "id string"))
    store.add(make(("a", "3"), ("b", "3")))
    read = lambda s: {r["id"]: r["content"] for r in s.rows().collect()}
    assert read(store) == {"a": "3", "b": "1"}
    other = dense.VectorStore(spark, str(tmp_path / "v"))
    other.compact()
    assert read(store) == {"a": "3", "b": "1"} and len(other.kept.live()) == 1


def test_knn_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(700, 6)), 1)  # with ties
    df = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    asked = df.select(F.col("id").alias("query_id"), "embedding")
    monkeypatch.setattr(dense, "ROWS_AT_ONCE", 64)
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 50)
    names = np.array([f"v{i:03}" for i in range(700)])
    for metric in ("l2", "cosine"):
        got: dict = {}
        for r in dense.knn(df, asked, 4, metric, include_self=False).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i in range(0, 700, 97):
            d = ((x - x[i]) ** 2).sum(1) if metric == "l2" else 1 - u @ u[i]
            d[i] = np.inf
            assert got[names[i]] == names[np.lexsort((names, np.round(d, 12)))][:4].tolist()


def test_fetch_retries_and_decodes():
    calls, slept = [], []

    def transport(url, timeout):
        calls.append((url, timeout))
        if len(calls) == 1:
            raise OSError
        return (503, {}, b"") if len(calls) == 2 else (200, {"Content-Encoding": "gzip", "content-type": "text/html; charset=latin-1"}, gzip.compress("año".encode("latin-1")))

    assert web.fetch("u", transport, sleep=slept.append) == "año" and slept == [2.0, 2.0] and calls[0][1] == 8.0
    calls.clear()
    assert web.fetch("u", lambda *a: (404, {}, b""), sleep=slept.append) is None and len(slept) == 4
    assert web.decoded({}, "ñ".encode()) == "ñ" and web.decoded({}, b"\xf1") == "ñ"
    assert web.decoded({}, '<meta charset="cp1250">'.encode() + b"\x9c").endswith("ś") and web.decoded({}, b"charset=nosuch \xf1").endswith("ñ")
    assert web.unpacked({"Content-Encoding": "deflate"}, b"plain") == b"plain"


def test_pages_and_robots_tables(spark):
    def transport(url, timeout):
        if "down" in url:
            raise OSError
        return 200, {}, (f"rules of {url} {timeout}" if url.endswith("robots.txt") else f"<p>{url}").encode()

    got = {r["url"]: r["html"] for r in web.fetch_pages(spark.createDataFrame([("a",), ("down",), (None,)], "url string"), transport, sleep=lambda s: None).collect()}
    assert got == {"a": "<p>a", "down": None, None: None}
    now = datetime(2024, 1, 1, 12)
    known = spark.createDataFrame([("fresh", "old", datetime(2024, 1, 1, 11, 30)), ("stale", "old", datetime(2024, 1, 1, 10)), ("other", "old", now)], web.ROBOTS)
    asked = spark.createDataFrame([("fresh",), ("stale",), ("down",), ("",), (None,)], "domain string")
    rules = {r["domain"]: r["rules"] for r in web.fetch_robots(asked, known, now, transport, sleep=lambda s: None).collect()}
    assert rules == {"fresh": "old", "stale": "rules of https://stale/robots.txt 30.0", "down": None}
    urls = spark.createDataFrame([("https://down/x",), ("nohost",), (None,)], "url string")
    assert all(r["allowed"] for r in crawl.robots_allowed(urls, spark.createDataFrame([("down", None)], "domain string, rules string"), "MiCrawler/1.0").collect())


def test_the_page_limit_stops_the_crawl(spark):
    site = {"http://h/a": ["/c", "/b"], "http://h/b": ["/e"], "http://h/c": ["/d", "/e"], "http://h/d": [], "http://h/e": []}
    table = spark.createDataFrame([(u, " " + "".join(f'<a href="{x}">y</a>' for x in links)) for u, links in site.items()], "url string, html string")
    seeds, robots = spark.createDataFrame([("http://h/a", 0)], "url string, seq int"), spark.createDataFrame([], "domain string, rules string")
    order = [r["url"][-1] for r in crawl.crawl(table, seeds, robots, 3, valid=F.lit(True)).collect()]
    assert order == ["a", "c", "b", "d", "e"]
    assert [r["url"][-1] for r in crawl.crawl(table, seeds, robots, 3, 2, valid=F.lit(True)).collect()] == ["a", "c"]
    assert crawl.crawl(table, seeds, robots, 3, 0, valid=F.lit(True)).count() == 0


def test_the_ticker_pointer_goes_from_the_last_block_only(spark):
    text = "La crónica sigue minuto a minuto desde la plaza. " + "x" * 600
    html = f'<div class="ArticleView-text"><div class="Text-root"><p>{text}</p><p>{"y" * 300}</p><p>Fin, MINUTO A MINUTO: siga aquí</p></div></div>'
    only = f'<div class="ArticleView-text"><div class="Text-root"><p>{text}</p><p>. Minuto a minuto</p></div></div>'
    made = spark.createDataFrame([("https://actualidad.rt.com/1", html), ("https://actualidad.rt.com/2", only)], "url string, html string")
    got = {r["url"][-1]: r["content"] for r in pages.extract_articles(made).collect()}
    assert got["1"] == f"{text}\n\n{'y' * 300}\n\nFin" and got["2"] == text


def test_site_rules_for_metadata():
    bad, article = ("", "{"), ("", json.dumps({"@type": "Article", "author": [{"name": "A"}, {}]}))
    assert pages.site_metadata("bbc", [bad, article]) == (None, [])
    assert pages.site_metadata("rt", [("", '{"@type": "WebPage", "author": {"name": "N"}}'), article]) == (None, ["A"]) and pages.site_metadata("rt", [bad]) == (None, None)
    assert pages.site_metadata("lanacion", [article]) == (None, None) and pages.site_metadata("lanacion", [(pages.NEWS_SCHEMA, article[1])]) == (None, ["A"])
    assert pages.site_metadata("telesur", [("", json.dumps([{"author": {"name": " A "}}, {"author": [{"name": "A"}, {"name": "B"}]}, 3]))]) == (None, ["A", "B"])
    assert pages.site_metadata("telemundo", [bad, ("", '{"datePublished": "d"}')]) == ("d", None) and pages.site_metadata("base", [article]) == (None, None)


def test_answers_and_server(spark, tmp_path):
    given = spark.createDataFrame([(1, 2, "", "u", None), (1, 1, "i", "v", "t")], "query_id bigint, rank int, id string, url string, title string")
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id bigint, q string")
    got = {r["query_id"]: r["results"] for r in answers.answers(asked, given).collect()}
    assert [(x["id"], x["title"], x["date"], x["score"]) for x in got[1]] == [("i", "t", "", 0.0), ("u", None, "", 0.0)] and got[2] == []
    assert answers.standardized(given.drop("title")).first()["title"] == "Sin título"
    engine = Engine(spark, Settings())
    docs = rows(spark, ("u1", "Economía y turismo."), ("u2", "Medicina digital."))
    engine.index_documents(docs, str(tmp_path / "ix"))
    assert engine.index_vectors(docs.withColumn("date", F.lit("2024-01-01")), str(tmp_path / "v")) == 2
    assert Engine(spark).open(str(tmp_path / "ix"), str(tmp_path / "v")).answer("dense", "turismo", 1)["results"][0]["date"] == "2024-01-01"
    own = answers.server(engine, port=0)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    get = lambda path: json.load(urlopen(f"http://127.0.0.1:{own.server_port}{path}"))
    assert get("/search/sparse?q=econom%C3%ADa")["results"][0]["id"] == "u1" and get("/search/hybrid?q=medicina&k=1")["query"] == "medicina"
    with pytest.raises(Exception, match="422"):
        get("/search/sparse")
    own.shutdown()
    engine.delete_vectors(spark.createDataFrame([("u1_0",)], "id string"))
    assert engine.vectors.count() == 1


def test_web_results_are_stored(spark, tmp_path):
    engine = Engine(spark)
    engine.index_documents(rows(spark, ("u1", "Economía.")), str(tmp_path / "ix"))
    feed = spark.createDataFrame([(0, p, f"w{p}", "t", "resumen nuevo", None, "f") for p in range(7)], "query_id bigint, position int, link string, title string, summary string, published timestamp, source string")
    got = engine.search_with_fallback("nada", feed, store=True)
    assert got.count() == 5 and engine.count() == 6
    assert engine.sparse("resumen").first()["id"].startswith("web_")
