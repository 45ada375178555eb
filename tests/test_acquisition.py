import json

from pyspark.sql import functions as F

from tamiz.config import Settings
from tamiz.operators import chunker, crawl
from tamiz.sources import files, pages
from tamiz.streaming import ingest


def test_url_filter(spark):
    urls = ["https://www.bbc.com/a", "ftp://bbc.com/a", "https://bbc.com/x.PDF", "http://notbbc.com.evil/", None, "mailto:a@bbc.com", "https://evil.org/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(crawl.is_valid_url(F.col("url"))).collect()] == [True, False, False, True, False, False, False]
    assert [r[0] for r in df.select(crawl.is_valid_url(F.col("url"), strict_host=True)).collect()][3] is False


def test_crawl(spark):
    site = {"http://h/a": ["/b", "/c", "#x"], "http://h/b": ["/a", "/d"], "http://h/d": ["/e"], "http://h/no": []}
    rows = [(u, "".join(f'<a href="{x}">y</a>' for x in links)) for u, links in site.items()] + [("http://h/e", None)]
    found = crawl.crawl(
        spark.createDataFrame(rows, "url string, html string"), spark.createDataFrame([("http://h/a",), ("http://h/no",)], "url string"),
        spark.createDataFrame([("h", "User-agent: *\nDisallow: /no")], "domain string, rules string"), 2, valid=F.lit(True),
    )
    assert [(r["url"], r["depth"]) for r in found.collect()] == [("http://h/a", 0), ("http://h/b", 1), ("http://h/d", 2)]


def page(text, head="", tag="article"):
    return f"<html><head><title>T</title>{head}</head><body><{tag}><h1>Título</h1><p>{text}</p></{tag}><script>var x='<p>no</p>'</script></body></html>"


def test_extraction(spark):
    og = '<meta property="og:type" content="{}">'
    ld = '<script type="application/ld+json">{}</script>'
    long, short = "x" * 500, "x" * 499
    article = {"@graph": [{"@type": "NewsArticle", "datePublished": "2024-01-02T03:04:05Z", "author": [{"name": "Ana"}, {"name": "Ana"}, {"name": "Luis"}]}]}
    rows = [
        ("http://www.x.org/1", page(long)), ("http://x.org/2", page(short)), ("http://x.org/3", page(long, og.format("website"))), ("http://x.org/4", page(long, '<meta property="og:type">')),
        ("http://x.org/5", page(long, og.format("article") + ld.format(json.dumps(article)))), ("http://x.org/6", page(long, ld.format("{bad"))), ("http://x.org/7", None), ("http://x.org/8", "<p><b"),
        ("https://www.bbc.com/9", f'<title>T</title><div class="css-1k9op6x e17x9cvu0"><p>{long}</p><p>con <a href="/">enlace</a></p></div><div><p>fuera</p></div>'),
    ]
    got = {r["url"][-1]: r for r in pages.extract_articles(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert set(got) == {"1", "5", "6", "9"}
    assert got["1"]["source"] == "x.org" and got["1"]["title"] == "Título" and got["1"]["content"] == long
    assert got["5"]["authors"] == ["Ana", "Luis"] and got["5"]["date"].year == 2024
    assert got["6"]["date"] is None and got["9"]["content"] == long


def test_jsonl(spark, tmp_path):
    lines = [
        '{"source": "s", "url": "u1", "content": "c", "published_date": "2024-01-01T00:00:00Z"}', "", "{bad", '{"source": "s", "url": "u2", "content": "ñ", "title": "t", "authors": ["a"], "published_date": "x"}',
        '{"source": "s", "content": "no url"}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = {r["url"]: r for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()}
    assert set(got) == {"u1", "u2"} and got["u1"]["title"] == "" and got["u1"]["authors"] == [] and got["u1"]["date"] is not None and got["u2"]["date"] is None
    assert files.read_jsonl(spark, str(tmp_path / "none")).count() == 0
    docs = files.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    files.write_jsonl(docs, str(tmp_path / "out"))
    files.write_jsonl(docs, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 4
    assert "ñ" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_urls_and_feed(spark, tmp_path):
    (tmp_path / "seeds").write_text(" http://a \n\nhttp://b\n")
    seeds = files.read_urls(spark, str(tmp_path / "seeds"))
    assert sorted(r["url"] for r in seeds.collect()) == ["http://a", "http://b"]
    (tmp_path / "empty").write_text("")
    assert files.read_urls(spark, str(tmp_path / "empty"), seeds).count() == 2
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title>t</title><link>http://l</link><pubDate>Thu, 05 Jan 2023 10:12:56 GMT</pubDate><description>d</description></item>"
        "<item><title>u</title><link>http://m</link><pubDate></pubDate></item></channel></rss>"
    )
    got = files.read_feed(spark, str(tmp_path / "f.xml"), as_of="2020-01-01 00:00:00").orderBy("title").collect()
    assert [r["link"] for r in got] == ["http://l", "http://m"] and got[0]["published"].year == 2023 and got[1]["published"].year == 2020
    assert files.read_feed(spark, str(tmp_path / "gone")).count() == 0


def test_chunk_packing():
    assert chunker.pack_units([100, 1000, 50], 1024, 153) == [[0], [0, 1], [2]]
    assert chunker.pack_units([4, 4, 4, 4], 10, 4) == [[0, 1], [1, 2], [2, 3]]
    assert chunker.sentences("Habló el Sr. Paz. ¿Sí? No…  Fin") == ["Habló el Sr. Paz.", "¿Sí?", "No…", "Fin"]


def test_chunks(spark):
    docs = spark.createDataFrame([("u", "s", None, "Uno dos. Tres cuatro. " * 40, None, None), ("v", "s", "", "", None, None)], "url string, source string, title string, content string, authors array<string>, date timestamp")
    got = chunker.chunk(docs, Settings(max_tokens=40, overlap_percent=20)).orderBy("metadata.chunk_number").collect()
    assert {r["metadata"]["doc_id"] for r in got} == {"u"} and got[0]["id"] == "u_0"
    assert all(r["metadata"]["estimated_tokens"] <= 40 for r in got)


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, text in enumerate(("viejo", "nuevo")):
        (folder / f"{n}.json").write_text(json.dumps({"source": "s", "url": "u", "content": text}) + "\n")
        query = ingest.upsert_stream(ingest.document_stream(spark, str(folder)), str(tmp_path / "t"), str(tmp_path / "cp"))
        query.awaitTermination(60)
    got = ingest.current(spark, str(tmp_path / "t")).collect()
    assert len(got) == 1 and got[0]["content"] == "nuevo"
