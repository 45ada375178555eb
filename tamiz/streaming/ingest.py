"""Incremental indexing of arriving JSON-lines files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..functions.dates import parse_iso


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the JSON-lines files of ``folder``, as they arrive."""
    rows = spark.readStream.schema(schema.JSONL).json(folder)
    rows = rows.where(F.col("url").isNotNull() & F.col("content").isNotNull())
    return rows.select("source", "url", F.coalesce("title", F.lit("")).alias("title"), "content", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), parse_iso(F.col("published_date")).alias("date"))


def upsert_stream(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its number; ``current`` reads the last version of every url.

    A batch that is run again after a failure writes the same folder again, so each counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/part={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of each url."""
    from ..operators.index import latest

    return latest(spark.read.parquet(table).drop("part"), "url", F.desc("batch"), F.desc("content")).drop("batch")


def arrivals(stream: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Documents a source and time window, with a watermark for late ones."""
    return stream.withWatermark("date", late).groupBy(F.window("date", width), "source").agg(F.count("*").alias("n_docs"))
