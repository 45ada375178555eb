"""Reciprocal rank fusion of a sparse and a dense ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import rrf


def fuse(sparse: DataFrame, dense: DataFrame, k: int = 10, rrf_k: int = 60, fuse_on: str = "id") -> DataFrame:
    """(query_id, rank, id, rrf_score, in_sparse, in_dense) of the ``k`` best of both rankings.

    Both have (query_id, id, rank); ``dense`` also has doc_id where ``fuse_on`` is "doc": its chunks then
    count as their document, at the best rank. Ties: sparse first, then by rank.
    """
    if fuse_on == "doc":
        dense = dense.groupBy("query_id", F.col("doc_id").alias("id")).agg(F.min("rank").alias("best"))
        order = Window.partitionBy("query_id").orderBy("best", "id")
        dense = dense.withColumn("rank", F.row_number().over(order))
    both = sparse.select("query_id", "id", "rank", F.lit(0).alias("leg")).unionByName(dense.select("query_id", "id", "rank", F.lit(1).alias("leg")))
    fused = both.groupBy("query_id", "id").agg(
        F.sum(rrf(F.col("rank"), rrf_k)).alias("rrf_score"),
        F.min("leg").alias("leg"),
        F.min(F.struct("leg", "rank")).alias("first"),
        F.max((F.col("leg") == 0).cast("int")).alias("in_sparse"),
        F.max((F.col("leg") == 1).cast("int")).alias("in_dense"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "leg", F.col("first.rank"), "id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "rrf_score", "in_sparse", "in_dense")


def hybrid_results(fused: DataFrame, sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Fused rows with what they show: a sparse row its own score, url, title and snippet; a dense row no score,
    its chunk id as url, and its own title and snippet."""
    left = sparse.select(F.col("query_id").alias("s_query"), F.col("id").alias("s_id"), F.col("url").alias("s_url"), F.col("title").alias("s_title"), F.col("source").alias("s_source"), F.col("score").alias("s_score"), F.col("snippet").alias("s_snippet"))
    right = dense.select(F.col("query_id").alias("d_query"), F.col("id").alias("d_id"), F.col("title").alias("d_title"), F.col("source").alias("d_source"), F.col("snippet").alias("d_snippet"))
    rows = fused.join(left, (F.col("query_id") == F.col("s_query")) & (F.col("id") == F.col("s_id")), "left")
    rows = rows.join(right, (F.col("query_id") == F.col("d_query")) & (F.col("id") == F.col("d_id")), "left")
    pick = lambda a, b: F.when(F.col("s_id").isNotNull(), F.col(a)).otherwise(F.col(b))
    return rows.select(
        "query_id", "rank", "id", F.coalesce("s_url", "id").alias("url"), pick("s_title", "d_title").alias("title"), pick("s_source", "d_source").alias("source"),
        F.col("s_score").alias("score"), pick("s_snippet", "d_snippet").alias("snippet"), "rrf_score",
    )
