"""Crawling over a table of fetched pages: link filter, robots rules, level-by-level search."""

from __future__ import annotations

from urllib import robotparser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import netloc, urljoin
from ..session import cut

# Hosts that may be crawled, and endings of what is not a page.
ALLOWED_DOMAINS = "cubadebate.cu oncubanews.com bbc.com lanacion.com telesurtv.net actualidad.rt.com presidencia.gob.cu telemundo.com".split()
BLOCKED_ENDINGS = ".pdf .jpg .jpeg .png .gif .zip .rar .mp4 .mp3 .css .js".split()


def is_valid_url(url: Column, domains: list[str] = ALLOWED_DOMAINS, blocked: list[str] = BLOCKED_ENDINGS, strict_host: bool = False) -> Column:
    """http or https, a host that contains an allowed domain (``strict_host``: is one or ends in it), and a path
    without a blocked ending. NULL and malformed urls are not valid."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = netloc(url)
    if strict_host:
        bare = F.lower(F.regexp_replace(host, r"^.*@|:\d+$", ""))
        allowed = F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (bare == d) | bare.endswith(F.concat(F.lit("."), d)))
    else:
        allowed = F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: F.contains(host, d))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    ending = F.exists(F.array(*[F.lit(b) for b in blocked]), lambda b: path.endswith(b))
    return F.coalesce(scheme.isin("http", "https") & allowed & ~ending, F.lit(False))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls`` (url, ...) with ``allowed``: the host's rules for ``agent``; a url without a host, a host without
    rules and rules that cannot be read allow everything. ``robots``: (domain, rules), one row a domain."""
    rows = urls.withColumn("__host", netloc(F.col("url")))
    rows = rows.join(robots.select(F.col("domain").alias("__domain"), "rules"), F.col("__host") == F.col("__domain"), "left")

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, rules: pd.Series) -> pd.Series:
        parsers: dict[str, robotparser.RobotFileParser] = {}
        out = []
        for u, r in zip(url, rules, strict=True):
            if u is None or not r:
                out.append(True)
                continue
            if r not in parsers:
                parsers[r] = robotparser.RobotFileParser()
                parsers[r].parse(r.splitlines())
            out.append(parsers[r].can_fetch(agent, u))
        return pd.Series(out, dtype=bool)

    return rows.withColumn("allowed", allowed("url", "rules")).drop("__host", "__domain", "rules")


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst): the distinct absolute http links of each page's anchors."""
    return placed_links(pages).select("src", "dst")


def placed_links(pages: DataFrame) -> DataFrame:
    """(src, dst, pos): ``page_links`` with the place of each link's first anchor in its page."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    links = pages.where(F.col("html").isNotNull()).select(F.col("url").alias("src"), F.posexplode(F.array_distinct(hrefs)).alias("pos", "href"))
    links = links.select("src", "pos", urljoin("src", "href").alias("dst"))
    return links.where(F.col("dst").startswith("http")).groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def crawl(pages: DataFrame, seeds: DataFrame, robots: DataFrame, max_depth: int = 3, max_pages: int | None = None, agent: str = "MiCrawler/1.0", valid: Column | None = None) -> DataFrame:
    """(url, depth, place) of the fetched pages, first in, first out, from ``seeds`` (url, and perhaps seq, their order).

    ``pages`` (url, html) is what a fetch would give: a url that is not in it (or has no html) failed and is not
    visited. A forbidden url is visited but not fetched. ``place`` is the queue's order: inside a level the page by
    which a url was first found, then the anchor's place in it. One job a level, each ending in a written table; links
    are expanded below ``max_depth``. Fetching stops at ``max_pages``: a level takes what is left of it, and no later
    level is touched.
    """
    check = is_valid_url(F.col("url")) if valid is None else valid
    pages = pages.where(F.col("html").isNotNull() & (F.col("html") != "")).dropDuplicates(["url"])
    seq = F.col("seq").cast("long") if "seq" in seeds.columns else F.monotonically_increasing_id()
    frontier = seeds.select("url", F.array(seq).alias("place")).where(F.col("url").isNotNull()).groupBy("url").agg(F.min("place").alias("place"))
    visited, found, taken = None, None, 0
    for depth in range(max_depth + 1):
        judged = cut(robots_allowed(frontier.withColumn("depth", F.lit(depth)), robots, agent), "frontier")
        got = judged.where("allowed").join(pages.select(F.col("url").alias("p_url")), F.col("url") == F.col("p_url"), "left_semi").select("url", "depth", "place")
        if max_pages is not None:
            got = got.orderBy("place", "url").limit(max_pages - taken)
        got = cut(got, "fetched")
        taken += got.count()
        seen = judged.where(~F.col("allowed")).select("url").unionByName(got.select("url"))
        visited = seen if visited is None else visited.unionByName(seen)
        found = got if found is None else found.unionByName(got)
        if depth == max_depth or (max_pages is not None and taken >= max_pages):
            break
        here = pages.join(got.select(F.col("url").alias("g_url"), "place"), F.col("url") == F.col("g_url"))
        links = placed_links(here.select("url", "html")).join(got.select(F.col("url").alias("src"), "place"), "src")
        links = links.select(F.col("dst").alias("url"), F.concat("place", F.array(F.col("pos").cast("long"))).alias("place")).where(check)
        links = links.groupBy("url").agg(F.min("place").alias("place"))
        frontier = cut(links.join(visited.withColumnRenamed("url", "v_url"), F.col("url") == F.col("v_url"), "left_anti"), "next")
        if not frontier.limit(1).count():
            break
    return found.orderBy("depth", "place", "url")


def expand_frontier(frontier: DataFrame, visited: DataFrame, links: DataFrame) -> DataFrame:
    """New (url, depth) rows: links of frontier pages that neither table has."""
    step = frontier.join(links, F.col("url") == F.col("src")).groupBy("dst").agg((F.min("depth") + 1).alias("depth"))
    known = frontier.select(F.col("url").alias("k")).unionByName(visited.select(F.col("url").alias("k"))).distinct()
    return step.join(known, F.col("dst") == F.col("k"), "left_anti").select(F.col("dst").alias("url"), "depth")
