"""Web fallback: how insufficient local results are, feed rows as results and documents, the combined list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.scoring import insufficiency
from ..functions.text import short_id


def insufficiency_scores(queries: DataFrame, local: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, n_results, avg_score, insufficiency_score, triggered); the average leaves NULL scores out,
    and the search is triggered strictly over the threshold."""
    found = local.groupBy(F.col("query_id").alias("l_query")).agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))
    rows = queries.select("query_id").distinct().join(found, F.col("query_id") == F.col("l_query"), "left")
    rows = rows.select("query_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_results"), "avg_score")
    score = insufficiency(F.col("n_results"), F.col("avg_score"), settings.min_results, settings.min_score)
    return rows.withColumn("insufficiency_score", score).withColumn("triggered", F.col("insufficiency_score") > settings.insufficiency_threshold)


def feed_results(feed: DataFrame) -> DataFrame:
    """Feed rows as results: score 0, the first 200 characters of the summary without an ellipsis."""
    return feed.select(
        F.col("link").alias("id"), F.col("link").alias("url"), "title", "source", F.col("published").alias("date"), F.lit(0.0).alias("score"), F.substring("summary", 1, 200).alias("snippet")
    )


def feed_documents(feed: DataFrame) -> DataFrame:
    """Feed rows as index documents under their short id; authors stay NULL."""
    return feed.select(
        short_id(F.col("link")).alias("doc_id"), "source", F.col("link").alias("url"), "title", F.col("summary").alias("content"), F.lit(None).cast("array<string>").alias("authors"), F.col("published").alias("date")
    )


def combine(local: DataFrame, web: DataFrame) -> DataFrame:
    """(query_id, position, origin, url, ...) of local rows, then web rows with new urls.

    Both have (query_id, position, url). A local row without a url drops out, local repetitions stay;
    of web rows the first of each url stays unless a local row has it.
    """
    kept = local.where(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("origin", F.lit("local"))
    have = kept.select(F.col("query_id").alias("h_query"), F.col("url").alias("h_url")).distinct()
    order = Window.partitionBy("query_id", "url").orderBy("position")
    fresh = web.where(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1).drop("__r")
    fresh = fresh.join(have, (F.col("query_id") == F.col("h_query")) & (F.col("url") == F.col("h_url")), "left_anti").withColumn("origin", F.lit("web"))
    both = kept.unionByName(fresh, allowMissingColumns=True)
    place = Window.partitionBy("query_id").orderBy(F.when(F.col("origin") == "local", 0).otherwise(1), "position")
    return both.withColumn("position", F.row_number().over(place))


def used_feed(queries: DataFrame, local: DataFrame, feed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of ``feed`` that answer: the first ones of each query whose local results do not suffice."""
    judged = insufficiency_scores(queries, local, settings).where("triggered").select(F.col("query_id").alias("j_query"))
    order = Window.partitionBy("query_id").orderBy("position")
    first = feed.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= settings.web_results_limit).drop("__r")
    return first.join(judged, F.col("query_id") == F.col("j_query"), "left_semi")


def search_with_fallback(queries: DataFrame, local: DataFrame, feed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Local results, and for each query whose results do not suffice the feed's first rows.

    ``local`` has (query_id, rank, url, title, source, score, snippet); ``feed`` (query_id, position, link,
    title, summary, published, source), the answer to each query. Adds ``triggered`` and
    ``insufficiency_score`` to every row; a query without any row at all is in none.
    """
    judged = insufficiency_scores(queries, local, settings).select(F.col("query_id").alias("j_query"), "insufficiency_score", "triggered")
    web = used_feed(queries, local, feed, settings).select("query_id", "position", F.col("link").alias("url"), "title", "source", F.lit(0.0).alias("score"), F.substring("summary", 1, 200).alias("snippet"))
    mine = local.select("query_id", F.col("rank").alias("position"), "url", "title", "source", "score", "snippet")
    return combine(mine, web).join(judged, F.col("query_id") == F.col("j_query")).drop("j_query")
