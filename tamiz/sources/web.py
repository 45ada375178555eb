"""Fetching over a pluggable transport: pages with attempts and back-off, robots rules with a time to live.

A transport is a function (url, timeout) -> (status, headers, body); it may raise. ``http_get`` is the one that uses the
network. The engine itself only needs the tables that come out: (url, html) and (domain, rules, fetched_at).
"""

from __future__ import annotations

import gzip
import re
import time
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, float], tuple[int, dict[str, str], bytes]]

ATTEMPTS, TIMEOUT, BACK_OFF = 3, 8.0, 2.0  # of a page
ROBOTS_RETRIES, ROBOTS_TIMEOUT, ROBOTS_TTL = 2, 30.0, 3600  # of a host's rules
ROBOTS = "domain STRING, rules STRING, fetched_at TIMESTAMP"

_CHARSET = re.compile(rb"""(?i)charset\s*=\s*["']?([A-Za-z0-9_.:\-]+)""")


def http_get(url: str, timeout: float) -> tuple[int, dict[str, str], bytes]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"Accept-Encoding": "gzip, deflate"}), timeout=timeout) as got:
            return got.status, dict(got.headers), got.read()
    except HTTPError as e:
        return e.code, dict(e.headers), b""


def unpacked(headers: dict[str, str], body: bytes) -> bytes:
    """The body without its content encoding (gzip, raw or wrapped deflate); what cannot be unpacked stays."""
    how = {k.lower(): v for k, v in headers.items()}.get("content-encoding", "").lower()
    try:
        if "gzip" in how:
            return gzip.decompress(body)
        if "deflate" in how:
            try:
                return zlib.decompress(body, -zlib.MAX_WBITS)
            except zlib.error:
                return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def decoded(headers: dict[str, str], body: bytes) -> str:
    """UTF-8 if it is valid, else the charset that the header or the page names, else Latin-1."""
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        pass
    kind = {k.lower(): v for k, v in headers.items()}.get("content-type", "").encode("ascii", "ignore")
    named = _CHARSET.search(kind) or _CHARSET.search(body[:2048])
    if named:
        try:
            return body.decode(named[1].decode("ascii"))
        except (LookupError, UnicodeDecodeError):
            pass
    return body.decode("latin-1")


def fetch(url: str, transport: Transport, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, pause: Callable[[int], float] = lambda n: BACK_OFF, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The text of ``url``, or None after ``attempts`` that raised or gave another status than 200; ``pause(n)`` seconds
    after the n-th of them, none after the last."""
    for n in range(1, attempts + 1):
        try:
            status, headers, body = transport(url, timeout)
            if status == 200:
                return decoded(headers, unpacked(headers, body))
        except Exception:
            pass
        if n < attempts:
            sleep(pause(n))
    return None


def fetch_pages(urls: DataFrame, transport: Transport = http_get, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, html) of ``urls`` (url): NULL html where the fetch failed. ``delay`` seconds between two fetches of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = []
            for url in batch["url"]:
                pages.append(None if url is None else fetch(url, transport, sleep=sleep))
                if delay:
                    sleep(delay)
            yield pd.DataFrame({"url": batch["url"], "html": pd.Series(pages, index=batch.index, dtype=object)})

    return urls.select("url").mapInPandas(run, "url STRING, html STRING")


def fetch_robots(domains: DataFrame, known: DataFrame | None, now: datetime, transport: Transport = http_get, ttl: int = ROBOTS_TTL, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(domain, rules, fetched_at) of ``domains`` (domain): what ``known`` has and is younger than ``ttl`` seconds stays, the
    rest is fetched from /robots.txt with retries after 2, then 4 seconds. Rules that cannot be had are NULL, which
    allows everything, and are kept as long as any. NULL and '' domains are left out."""
    asked = domains.where(F.col("domain").isNotNull() & (F.col("domain") != "")).select("domain").distinct()
    fresh = None
    if known is not None:
        fresh = known.where(F.col("fetched_at") > F.lit(now - timedelta(seconds=ttl))).select("domain", "rules", "fetched_at")
        fresh = fresh.join(asked.select(F.col("domain").alias("a_domain")), F.col("domain") == F.col("a_domain"), "left_semi")
        asked = asked.join(fresh.select(F.col("domain").alias("f_domain")), F.col("domain") == F.col("f_domain"), "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rules = [fetch(f"https://{d}/robots.txt", transport, ROBOTS_RETRIES + 1, ROBOTS_TIMEOUT, lambda n: BACK_OFF * n, sleep) for d in batch["domain"]]
            yield pd.DataFrame({"domain": batch["domain"], "rules": pd.Series(rules, index=batch.index, dtype=object), "fetched_at": pd.Timestamp(now)})

    got = asked.mapInPandas(run, ROBOTS)
    return got if fresh is None else fresh.unionByName(got)
