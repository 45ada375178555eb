"""Answers in the common form of all searches, as a table, as objects, and over HTTP."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of an item, and what stands for one that the search does not give.
DEFAULTS = {"title": "Sin título", "url": "", "source": "", "date": "", "score": 0.0, "snippet": ""}


def standardized(found: DataFrame) -> DataFrame:
    """``found`` (query_id, rank, and any of id, title, url, source, date, score, snippet) with all of these fields.

    The id is the url where there is none or it is ''; a column that ``found`` lacks has the field's default, a NULL in
    a column it has stays NULL.
    """
    field = lambda c: F.col(c) if c in found.columns else F.lit(DEFAULTS[c])
    own = F.nullif(F.col("id"), F.lit("")) if "id" in found.columns else F.lit(None).cast("string")
    return found.select("query_id", "rank", F.coalesce(own, field("url")).alias("id"), *[field(c).alias(c) for c in DEFAULTS])


def answers(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, query, results): one row a query of ``queries`` (query_id, q), the items in order; none gives an empty list."""
    items = standardized(found)
    item = F.struct("id", *DEFAULTS)
    lists = items.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias("results"))
    kind = lists.schema["results"].dataType
    joined = queries.select("query_id", F.col("q").alias("query")).join(lists, "query_id", "left")
    return joined.select("query_id", "query", F.coalesce("results", F.array().cast(kind)).alias("results"))


def answer(engine, way: str, q: str, k: int = 10) -> dict:
    """{"query", "results"} of one search, ``way`` being sparse, dense or hybrid."""
    asked = engine.queries(q, k)
    row = answers(asked, getattr(engine, way)(asked)).select(F.to_json("results", {"ignoreNullFields": "false"}).alias("r")).first()
    return {"query": q, "results": json.loads(row["r"])}


def server(engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """GET /search/{sparse,dense,hybrid}?q=&k=10, and a greeting at /; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            where = urlsplit(self.path)
            way, asked = where.path.rpartition("/")[2], parse_qs(where.query, keep_blank_values=True)
            try:
                if where.path == "/":
                    self._send(200, {"message": "tamiz"})
                elif where.path not in ("/search/sparse", "/search/dense", "/search/hybrid"):
                    self._send(404, {"detail": "not found"})
                elif "q" not in asked:
                    self._send(422, {"detail": "q is missing"})
                else:
                    self._send(200, answer(engine, way, asked["q"][0], int(asked.get("k", ["10"])[0])))
            except ValueError:
                self._send(422, {"detail": "k is no number"})

        def _send(self, status: int, what: dict) -> None:
            body = json.dumps(what, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
