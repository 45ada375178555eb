"""Vector collection and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.scoring import dense_score
from ..functions.text import snippet_always
from .generations import Generations, newest
from .index import latest

QUERY_BLOCK_BYTES = 64 << 20  # most bytes of query vectors that go to every task
ROWS_AT_ONCE, QUERIES_AT_ONCE = 2048, 512  # sides of one distance matrix: 8 MB
DIMENSIONS = 64
VECTOR = "id STRING, content STRING, doc_id STRING, title STRING, source STRING, date STRING, embedding ARRAY<FLOAT>"


def add_vectors(collection: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """``collection`` with those of ``rows`` whose id it lacks; an id it has is not overwritten."""
    fresh = rows.dropDuplicates([key]).join(collection.select(F.col(key).alias("__have")), F.col(key) == F.col("__have"), "left_anti")
    return collection.unionByName(fresh)


class VectorStore:
    """A persistent vector collection (see VECTOR for its columns), made empty where its folder is not there yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.kept = spark, Generations(spark, path)

    def rows(self) -> DataFrame:
        numbers = self.kept.live()
        found = self.kept.read("vectors", numbers, VECTOR)
        if found is None:
            return self.spark.createDataFrame([], VECTOR)
        gone = self.kept.read("deleted", numbers, "id STRING")
        return newest(found, gone, "id").drop("gen")

    def add(self, rows: DataFrame) -> None:
        """Append ``rows``; an id that is there is not overwritten, of rows with one id the first read stays, rows
        without an id are left out."""
        names = [part.strip().split(" ")[0] for part in VECTOR.split(", ")]
        rows = rows.where(F.col("id").isNotNull()).select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names])
        first = latest(rows.withColumn("__at", F.monotonically_increasing_id()), "id", F.asc("__at")).drop("__at")
        numbers, number = self.kept.live(), self.kept.next()
        if numbers:
            first = first.join(self.rows().select(F.col("id").alias("__have")), F.col("id") == F.col("__have"), "left_anti")
        self.kept.write(number, "vectors", first)
        self.kept.commit(number, [*numbers, number])

    def delete(self, ids: DataFrame) -> None:
        """Delete the rows of ``ids`` (id); an id may be added again later."""
        numbers, number = self.kept.live(), self.kept.next()
        self.kept.write(number, "deleted", ids.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id")).distinct())
        self.kept.commit(number, [*numbers, number])

    def compact(self) -> None:
        number = self.kept.next()
        self.kept.write(number, "vectors", self.rows())
        self.kept.commit(number, [number])

    def count(self) -> int:
        return self.rows().count()


def where_filter(spec: dict[str, Any], field=F.col) -> Column:
    """A metadata filter as a condition: equality, $eq $ne $gt $gte $lt $lte $in $nin, $and $or."""
    tests = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
    }
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            inner = [where_filter(s, field) for s in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
        elif isinstance(value, dict):
            parts += [tests[op](field(key), v) for op, v in value.items()]
        else:
            parts.append(field(key) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", where: Column | None = None, include_self: bool = True) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest of ``vectors`` (id, embedding) to each of ``queries``
    (query_id, embedding), ties by id. Distances: squared Euclidean ("l2") or 1 - cosine ("cosine").

    The queries are a stated set and go to the vectors in blocks of a bounded size; each task of the
    vectors keeps its own best ``k`` a query, and only those are shuffled. Vectors that are NULL, of
    another length than the query or not finite are no neighbours; with "cosine" neither are zero vectors.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"no metric named {metric!r}")
    if where is not None:
        vectors = vectors.where(where)
    vectors = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    size = asked.agg(F.max(F.size("embedding")).alias("d"), F.count("*").alias("n")).first()
    id_type = vectors.schema["id"].dataType.simpleString()
    query_type = asked.schema["query_id"].dataType.simpleString()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], f"query_id {query_type}, rank INT, id {id_type}, distance DOUBLE")
    per_block = max(1, QUERY_BLOCK_BYTES // (8 * max(1, size["d"])))
    blocks = -(-size["n"] // per_block)
    found = [
        _block(vectors, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k, metric, id_type, query_type, include_self) for b in range(blocks)
    ]
    near = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


class _Best:
    """The ``k`` nearest so far of each of a set of queries of one length, by distance, then id."""

    def __init__(self, ids: list, vectors: np.ndarray, k: int, metric: str, include_self: bool):
        self.ids, self.k, self.metric, self.include_self = np.array(ids, dtype=object), k, metric, include_self
        self.q = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if metric == "cosine" else vectors
        self.known = np.isfinite(self.q).all(1)
        self.worst = np.full(len(ids), np.inf)
        self.rows = pd.DataFrame({"q": np.zeros(0, np.int64), "id": [], "distance": np.zeros(0)})

    def add(self, names: np.ndarray, x: np.ndarray) -> None:
        if self.metric == "cosine":
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i in range(0, len(x), ROWS_AT_ONCE):
            for j in range(0, len(self.q), QUERIES_AT_ONCE):
                self._meet(names[i : i + ROWS_AT_ONCE], x[i : i + ROWS_AT_ONCE], j)

    def _meet(self, names: np.ndarray, x: np.ndarray, j: int) -> None:
        q = self.q[j : j + QUERIES_AT_ONCE]
        with np.errstate(invalid="ignore"):
            rough = 1 - q @ x.T if self.metric == "cosine" else (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
        rough[~self.known[j : j + QUERIES_AT_ONCE]] = np.inf
        if not self.include_self:
            rough[self.ids[j : j + QUERIES_AT_ONCE][:, None] == names] = np.inf
        limit = np.minimum(self.worst[j : j + QUERIES_AT_ONCE], np.partition(rough, min(self.k, len(x)) - 1, axis=1)[:, min(self.k, len(x)) - 1])
        # the expanded square is inexact by some roundings of its largest term
        slack = 1e-9 * (1 + np.abs(limit))
        if self.metric == "l2":
            slack += 1e-12 * ((q * q).sum(1) + (x * x).sum(1).max())
        at, row = np.nonzero((rough <= (limit + slack)[:, None]) & np.isfinite(rough))
        if not len(at):
            return
        # differences, not the expanded square: equal vectors must come out at 0
        exact = rough[at, row] if self.metric == "cosine" else ((x[row] - q[at]) ** 2).sum(1)
        both = pd.concat([self.rows, pd.DataFrame({"q": at + j, "id": names[row], "distance": exact})], ignore_index=True)
        both["r"] = both["distance"].round(12)
        both = both.sort_values(["q", "r", "id"], ignore_index=True)
        both = both[both.groupby("q").cumcount() < self.k]
        full = both.groupby("q")["distance"].agg(["size", "max"])
        full = full[full["size"] == self.k]
        self.worst[full.index.to_numpy()] = full["max"].to_numpy()
        self.rows = both[["q", "id", "distance"]]


def _block(vectors: DataFrame, asked: DataFrame, k: int, metric: str, id_type: str, query_type: str, include_self: bool) -> DataFrame:
    rows = asked.collect()  # a stated query set, at most QUERY_BLOCK_BYTES of it
    spark = vectors.sparkSession
    schema = f"query_id {query_type}, id {id_type}, distance DOUBLE"
    if not rows:
        return spark.createDataFrame([], schema)
    by_size: dict[int, tuple[list, list]] = {}
    for r in rows:
        ids, vecs = by_size.setdefault(len(r["embedding"]), ([], []))
        ids.append(r["query_id"])
        vecs.append(r["embedding"])
    shared = spark.sparkContext.broadcast({d: (ids, np.array(v, dtype=np.float64)) for d, (ids, v) in by_size.items()})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(invalid="ignore", divide="ignore"):
            best = {d: _Best(ids, q, k, metric, include_self) for d, (ids, q) in shared.value.items()}
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for d, own in best.items():
                part = batch[sizes == d]
                if not len(part):
                    continue
                x = np.array([np.asarray(v, dtype=np.float64) for v in part["embedding"]]).reshape(len(part), d)
                names = part["id"].to_numpy()
                good = np.isfinite(x).all(1) & ((x != 0).any(1) if metric == "cosine" else True)
                if good.any():
                    own.add(names[good], x[good])
        for own in best.values():
            if len(own.rows):
                yield pd.DataFrame({"query_id": own.ids[own.rows["q"].to_numpy()], "id": own.rows["id"].to_numpy(), "distance": own.rows["distance"].to_numpy()})

    return vectors.mapInPandas(search, schema)


def dense_results(near: DataFrame, payload: DataFrame) -> DataFrame:
    """(query_id, rank, id, url, title, source, date, score, snippet) of ``knn`` rows with the chunks' payload
    (id, content, doc_id, title, source, date); the snippet always ends in an ellipsis."""
    found = payload.withColumnRenamed("id", "p_id")
    joined = near.join(found, F.col("id") == F.col("p_id"))
    date = F.col("date") if "date" in payload.columns else F.lit(None).cast("string")
    return joined.select(
        "query_id", "rank", "id", F.col("doc_id").alias("url"), "title", "source", date.alias("date"), dense_score(F.col("distance")).alias("score"), snippet_always(F.col("content")).alias("snippet")
    )


def hashed_words(dimensions: int = DIMENSIONS):
    """A deterministic stand-in for an embedding model, as a column function: signed hashed word counts in ``dimensions``
    (a power of two up to 32,768) dimensions, of unit length. NULL gives NULL; a text without words the zero vector."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        import functools
        import hashlib
        import re

        word = re.compile(r"[^\W_]+")

        @functools.lru_cache(maxsize=100_000)
        def place(w: str) -> tuple[int, int]:
            h = int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
            return h % dimensions, 1 if h // dimensions % 2 else -1

        out = []
        for t in text:
            if t is None:
                out.append(None)
                continue
            v = np.zeros(dimensions)
            for w in word.findall(t.lower()):
                at, sign = place(w)
                v[at] += sign
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return embed


hashing_embedding = hashed_words()


def dimensionality(vectors: DataFrame) -> DataFrame:
    """(dimensions, n) of the vectors that are there."""
    return vectors.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("dimensions")).agg(F.count("*").alias("n"))
