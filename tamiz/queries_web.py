"""Registered queries of acquisition: pages, links, crawling, JSON lines, feeds, streams.

The tables have no pages, so these queries write them first: each document's lines as the page of one of eight sites,
laid out as that site does, and a graph of anchors over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .functions.dates import format_iso
from .operators import crawl
from .session import work_dir
from .sources import files
from .sources.pages import BBC_NOTICE, SITES, extract_articles
from .streaming import ingest

HOSTS = ["cubadebate.cu", "telemundo.com", "bbc.com", "actualidad.rt.com", "presidencia.gob.cu", "telesurtv.net", "lanacion.com.ar", "otros.example"]
KEPT = r"[^ -%'-;=?-~áéíóúüñÁÉÍÓÚÜÑ¿¡]"  # other characters are left out of the pages, so that no entity or composition matters
MAX_PAGES, MAX_DEPTH = 20, 3


def tidy(text):
    return F.trim(F.regexp_replace(F.regexp_replace(text, KEPT, " "), " +", " "))


def _ld(body: str, attrs: str = "") -> str:
    return f'<script type="application/ld+json"{attrs}>{body}</script>'


def pages(docs: DataFrame) -> DataFrame:
    """(url, html): every document of ``docs`` (row_id, title, content, fetched_at) as the page of one site."""
    n = F.col("row_id") % 8
    host = F.element_at(F.array(*[F.lit(h) for h in HOSTS]), (n + 1).cast("int"))
    docs = docs.withColumn("lines", F.filter(F.transform(F.split("content", "\n", -1), tidy), lambda x: x != "")).withColumn("at", F.concat(format_iso(F.col("fetched_at")), F.lit("Z")))
    block = lambda tag: F.array_join(F.transform("lines", lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag.split(' ')[0]}>"))), "")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    at = F.col("at")
    head = {
        0: put('<meta property="article:published_time" content="', at, '">'),
        1: put(_ld("{bad"), '<script type="application/ld+json">{"datePublished": "', at, '"}</script>'),
        2: put('<script type="application/ld+json">{"@graph": [{"datePublished": "', at, '", "author": [{"name": "Ana Paz"}, {"x": 1}]}]}</script>', _ld('{"@graph": [{"datePublished": "2001-01-01"}]}')),
        3: put(_ld('{"@type": "WebPage", "datePublished": "2001-01-01", "author": {"name": "Nadie"}}'), '<script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "', at, '", "author": {"name": "Luis Gil"}}</script>'),
        4: put('<meta property="article:published_time" content="', at, '"><meta property="article:author" content="Ana Paz / Luis Gil">'),
        5: put('<meta property="og:updated_time" content="', at, '">'),
        6: put(_ld('{"author": {"name": "Nadie"}}'), '<script type="application/ld+json" id="Schema_NewsArticle">{"datePublished": "', at, '", "author": [{"name": "Eva Mar"}, {"name": "Ana Paz"}, {"name": "Eva Mar"}]}</script>'),
        7: put('<script type="application/ld+json">[{"@graph": [{"author": "Eva Mar"}, {"datePublished": "', at, '"}]}]</script>'),
    }
    body = {
        0: put("<article>", block("p"), '<p><strong>Por</strong> <a href="#">Ana Paz</a> <a href="#">Luis Gil</a></p></article>'),
        1: put('<div class="article-body__content"><p class="body-graf">Por Ana Paz y Luis Gil</p>', block('p class="body-graf"'), '<div data-testid="article-faq-embed"><p class="body-graf">faq</p></div></div><p>fuera</p>'),
        2: put('<div class="css-1k9op6x e17x9cvu0">', block("p"), f'<h2>Fin</h2><p>ver <a href="/x">enlace</a></p><p>{BBC_NOTICE}</p><section><p>anidado</p></section></div><div class="css-1k9op6x"><p>otro</p></div>'),
        3: put('<div class="ArticleView-text"><div class="Text-root">', block("p"), '<div><p>hondo</p></div><p>Cierre, Minuto a Minuto: siga</p></div><div class="EmbedBlock-twitter"><h2>tuit</h2></div></div>'),
        4: put("<article>", block("p"), "</article>"),
        5: put("<article>", block("p"), '<p class="content-area__text__full__fuente__detalle">Autor: Ana Paz y Luis Gil, Eva Mar</p></article>'),
        6: put(block('p class="com-paragraph"'), '<p>banner</p><ul><li class="com-item">uno</li><li>dos</li></ul>'),
        7: put("<article>", block("p"), "</article>"),
    }
    pick = lambda parts: F.element_at(F.array(*[parts[i] for i in range(8)]), (n + 1).cast("int"))
    og = F.when(F.col("row_id") % 5 == 0, '<meta property="og:type" content="website">').when(F.col("row_id") % 5 == 1, "").otherwise('<meta property="og:type" content="article">')
    html = put("<html><head><title>", tidy(F.col("title")), "</title>", og, pick(head), "</head><body>", pick(body), "</body></html>")
    return docs.select(put("https://", F.when(F.col("row_id") % 2 == 0, "www.").otherwise(""), host, "/n", F.col("row_id").cast("string")).alias("url"), html.alias("html"))


def link_pages(docs: DataFrame) -> DataFrame:
    """(url, html): a page for each row, with anchors to rows of twice and three times its number, to no page, and to
    places that may not be crawled; every seventh row has no page."""
    r = F.col("row_id")
    to = lambda n: F.concat(F.lit('<a href="/p'), n.cast("string"), F.lit('">x</a>'))
    html = F.concat(to(r * 2), to(r * 3), to(r * 2), F.lit('<a class="y" href="https://bbc.com/p'), (r + 1).cast("string"), F.lit('">n</a><a href="/f.PDF">f</a><a href="mailto:a@bbc.com">m</a><a href="https://corval.example/z">z</a>'))
    return docs.where(r % 7 != 0).select(F.concat(F.lit("https://bbc.com/p"), r.cast("string")).alias("url"), html.alias("html"))


def register(table, latest) -> dict:
    """The queries by name, over ``table`` (spark, folder, name) and ``latest`` (spark, folder), the indexed documents."""

    def site_articles(spark, folder):
        """Articles of pages of all eight sites by the sites' rules."""
        got = extract_articles(pages(latest(spark, folder)), Settings(), SITES)
        return got.select("url", "source", "title", "content", F.array_join("authors", "|").alias("authors"), F.unix_micros("date").alias("us"))

    def feed_links(spark, folder):
        """Absolute links of pages that quote the feed: whole links, links within the host, and no web links."""
        items = table(spark, folder, "feed_items").where(F.col("link").isNotNull())
        one = F.concat(F.lit('<p><a href="'), "link", F.lit('">x</a> <A class=a href=\''), F.lit("/de/"), F.length("title").cast("string"), F.lit("'>y</A> <a href=\"mailto:x@y.z\">m</a></p>"))
        quoted = items.where(~F.col("link").rlike("[&'\"<>]")).select(F.concat(F.lit("https://lector.example/"), F.length("link").cast("string")).alias("url"), one.alias("html"))
        return crawl.page_links(quoted)

    def _graph(spark, folder):
        rows = table(spark, folder, "search_documents").select("row_id")
        seeds = spark.createDataFrame([(f"https://bbc.com/p{i}", n) for n, i in enumerate((3, 1, 7, 5))], "url STRING, seq INT")
        robots = spark.createDataFrame([("bbc.com", "User-agent: *\nDisallow: /p4")], "domain STRING, rules STRING")
        return link_pages(rows), seeds, robots

    def crawl_fifo(spark, folder):
        """A crawl of the graph, in the queue's order, until its page limit."""
        got = crawl.crawl(*_graph(spark, folder), MAX_DEPTH, MAX_PAGES)
        return got.select("url", F.col("depth").cast("long").alias("depth"), F.array_join("place", ".").alias("place"))

    def crawl_whole(spark, folder):
        """The same without a page limit."""
        return crawl.crawl(*_graph(spark, folder), MAX_DEPTH).select("url", F.col("depth").cast("long").alias("depth"))

    def robots_rules(spark, folder):
        """Every feed link against rules of its host; a host without rules allows all."""
        urls = table(spark, folder, "feed_items").select(F.col("link").alias("url")).where(F.col("url").isNotNull()).distinct()
        rules = [("www.malvenda.example", "User-agent: *\nDisallow: /rss/"), ("www.torrubel.example", "User-agent: MiCrawler\nDisallow: /\nUser-agent: *\nDisallow:")]
        return crawl.robots_allowed(urls, spark.createDataFrame(rules, "domain STRING, rules STRING"), "MiCrawler/1.0").select("url", "allowed")

    def frontier_step(spark, folder):
        """One step over the graph of anchors: new urls of the rows under 100, every third of which was visited."""
        found, _, _ = _graph(spark, folder)
        number = F.regexp_extract("url", r"p(\d+)$", 1).cast("long")
        frontier = found.where(number < 100).select("url", F.lit(0).alias("depth"))
        visited = found.where(number % 3 == 0).select("url")
        return crawl.expand_frontier(frontier, visited, crawl.page_links(found)).select("url", F.col("depth").cast("long").alias("depth"))

    def jsonl_documents(spark, folder):
        """Documents written as JSON lines and read back."""
        path = work_dir(spark, "jsonl")
        rows = table(spark, folder, "search_documents").select("source", "url", "title", "content", "authors", F.col("fetched_at").alias("date"))
        files.write_jsonl(rows, path)
        got = files.read_jsonl(spark, path)
        return got.select("url", "source", "title", F.length("content").cast("long").alias("n"), F.array_join("authors", "|", "?").alias("authors"), F.unix_micros("date").alias("us"))

    def feed_xml(spark, folder):
        """The feed written as RSS items with RFC 2822 dates and read back."""
        path = work_dir(spark, "feed")
        when = F.date_format("published", "d MMM yyyy HH:mm:ss")
        rows = table(spark, folder, "feed_items").select("title", "link", F.concat(F.lit("Mon, "), when, F.lit(" GMT")).alias("pubDate"), tidy(F.col("summary")).alias("description"))
        rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
        got = files.read_feed(spark, path, "RSS")
        return got.select("title", "link", F.unix_micros("published").alias("us"), "summary", "source")

    def seed_urls(spark, folder):
        """The feed's links as a text file with blanks and blank lines, read back."""
        path = work_dir(spark, "seeds")
        line = F.when(F.length("title") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "link", F.lit(" ")))
        table(spark, folder, "feed_items").where(F.col("link").isNotNull()).select(line.alias("value")).write.text(path)
        return files.read_urls(spark, path)

    def stream_documents(spark, folder):
        """JSON lines that arrive in two files, taken in by a stream; the last of each url."""
        path = work_dir(spark, "stream")
        rows = table(spark, folder, "search_documents").where(F.col("url").isNotNull()).select("row_id", "source", "url", "title", "content", "authors", F.col("fetched_at").alias("date"))
        for part in range(2):
            files.write_jsonl(rows.where(F.col("row_id") % 2 == part).groupBy("url").agg(*[F.max_by(c, "row_id").alias(c) for c in ("source", "title", "content", "authors", "date")]), f"{path}/in")
            ingest.upsert_stream(ingest.document_stream(spark, f"{path}/in"), f"{path}/table", f"{path}/checkpoint").awaitTermination()
        return ingest.current(spark, f"{path}/table").select("url", F.length("content").cast("long").alias("n"))

    def stream_arrivals(spark, folder):
        """Documents an hour and source, counted by a stream with a watermark."""
        path = work_dir(spark, "arrivals")
        rows = table(spark, folder, "search_documents").where(F.col("url").isNotNull() & F.col("content").isNotNull() & F.col("fetched_at").isNotNull())
        files.write_jsonl(rows.select("source", "url", "title", "content", "authors", F.col("fetched_at").alias("date")), f"{path}/in")
        counted = ingest.arrivals(ingest.document_stream(spark, f"{path}/in"))
        counts = counted.select(F.unix_micros("window.start").alias("hour_us"), "source", "n_docs")
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out")
        counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{path}/out")

    found = [site_articles, feed_links, crawl_fifo, crawl_whole, robots_rules, frontier_step, jsonl_documents, feed_xml, seed_urls, stream_documents, stream_arrivals]
    return {f.__name__: f for f in found}
