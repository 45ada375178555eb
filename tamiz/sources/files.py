"""File sources and sinks: JSON lines, url lists, feeds, vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.dates import format_iso, parse_feed_date, parse_iso


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Documents of a JSON-lines file. Blank and malformed lines are left out, an invalid date is NULL, a missing
    file gives no rows. ``strict``: a record without url or content fails the job; else it is left out."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema.DOCUMENT)
    rows = spark.read.schema(schema.JSONL + ", _bad STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where(F.col("_bad").isNull())
    whole = F.col("url").isNotNull() & F.col("content").isNotNull()
    if strict:
        rows = rows.withColumn("url", F.when(whole, F.col("url")).otherwise(F.raise_error(F.lit("a record lacks url or content"))))
    else:
        rows = rows.where(whole)
    return rows.select(
        "source", "url", F.coalesce("title", F.lit("")).alias("title"), "content", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), parse_iso(F.col("published_date")).alias("date")
    )


def write_jsonl(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Documents as JSON lines; the date as ISO text under ``published_date``, NULL fields left out."""
    docs.select("source", "url", "title", "authors", format_iso(F.col("date")).alias("published_date"), "content").write.mode(mode).json(path)


def read_urls(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """(url) of a text file, one a line, blanks stripped and blank lines left out; a missing or empty file gives
    ``fallback`` (seeds for a frontier) or nothing."""
    nothing = fallback if fallback is not None else spark.createDataFrame([], "url STRING")
    if not path_exists(spark, path):
        return nothing
    rows = spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url") != "")
    return rows if fallback is None or rows.limit(1).count() else fallback


def write_urls(urls: DataFrame, path: str) -> None:
    """Frontier or visited urls with their depth, replaced whole."""
    columns = [c for c in ("url", "depth", "seq") if c in urls.columns]
    urls.select(*columns).write.mode("overwrite").json(path)


def read_feed(spark: SparkSession, path: str, source: str = "RSS", limit: int | None = None, as_of=None) -> DataFrame:
    """Items of an RSS file, in the order of the feed. A date in neither usual form is ``as_of`` (NULL if not given);
    a missing or unreadable file gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema.FEED)
    rows = spark.read.format("xml").option("rowTag", "item").schema("title STRING, link STRING, pubDate STRING, description STRING").load(path)
    when = parse_feed_date(F.col("pubDate"), None if as_of is None else F.lit(as_of).cast("timestamp"))
    rows = rows.select("title", "link", when.alias("published"), F.coalesce("description", F.lit("")).alias("summary"), F.lit(source).alias("source"))
    if limit is None:
        return rows
    return rows.withColumn("__at", F.monotonically_increasing_id()).orderBy("__at").limit(limit).drop("__at")


def feed_url(query, language: str = "es-419", country: str = "US"):
    """The address a feed search would be sent to, as a column."""
    from ..functions.text import quote_plus

    return F.concat(F.lit("https://news.google.com/rss/search?q="), quote_plus(query), F.lit(f"&hl={language}&gl={country}&ceid={country}:es"))


def create_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table at ``path``, made empty if it is not there."""
    if not path_exists(spark, path):
        spark.createDataFrame([], ddl).write.parquet(path)
    return spark.read.schema(ddl).parquet(path)
