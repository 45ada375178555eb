"""Lines repeated across one source's documents, kept as incremental per-source counts.

``LineCounts`` holds two tables under one folder, as generations, one a delta: the lines of the delta's documents by
their key, which is also the way from a line to the documents that have it, and the counts (source, line, n_urls) that
the delta changed. A delta is analysed once; it reads the keys of earlier lines to tell new urls from known ones, and
writes its own lines and the changed counts only. The lines that cross the threshold by it lead to the documents that
have to be rebuilt, and no other document is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.generations import Generations
from ..session import cut

MIN_URLS = 8


def collapse(text: Column) -> Column:
    """Lower case, trimmed, each run of Unicode blanks one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def wording(line: Column) -> Column:
    """The form under which two lines count as the same: ``collapse``, then each run of digits ``0``."""
    return F.regexp_replace(collapse(line), r"(?U)\d+", "0")


def key128(text: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds; equal pairs stand for equal texts."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("b"), text).alias("k2")]


def explode_lines(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per line of ``content`` (split at newlines, counted from 1, blank ones included)."""
    lines = docs.where(F.col("content").isNotNull()).select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))
    return lines.select(*keep, (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def keyed_lines(docs: DataFrame) -> DataFrame:
    """(row_id, source, url_key, line_no, k1, k2) of every line with a wording."""
    lines = explode_lines(docs, ["row_id", "source", "url"]).withColumn("wording", wording(F.col("line")))
    lines = lines.where(F.col("wording") != "")
    url_key = F.when(F.col("url").isNotNull(), F.xxhash64("url"))
    return lines.select("row_id", "source", url_key.alias("url_key"), "line_no", *key128(F.col("wording")))


class LineCounts:
    COUNTS = "source STRING, k1 BIGINT, k2 BIGINT, n_urls BIGINT, was BIGINT"
    LINES = "row_id BIGINT, source STRING, url_key BIGINT, line_no BIGINT, k1 BIGINT, k2 BIGINT"

    def __init__(self, spark: SparkSession, path: str, min_urls: int = MIN_URLS):
        self.spark, self.min_urls, self.kept = spark, min_urls, Generations(spark, path)

    def _read(self, name: str, ddl: str, numbers: list[int]) -> DataFrame:
        found = self.kept.read(name, numbers, ddl)
        return self.spark.createDataFrame([], f"{ddl}, gen INT") if found is None else found

    def counts(self) -> DataFrame:
        """(source, k1, k2, n_urls): a count only grows, so the largest is the last."""
        numbers = self.kept.live()
        rows = self._read("counts", self.COUNTS, numbers).select("source", "k1", "k2", "n_urls")
        return rows if len(numbers) < 2 else rows.groupBy("source", "k1", "k2").agg(F.max("n_urls").alias("n_urls"))

    def repeated(self) -> DataFrame:
        """All (source, k1, k2) over the threshold."""
        return self.counts().where(F.col("n_urls") >= self.min_urls).select("source", "k1", "k2")

    def update(self, docs: DataFrame) -> DataFrame:
        """Merge one delta; return the (source, k1, k2) that crossed the threshold by it.

        Partial aggregations, so a line or a source that a third of all rows share is combined before the shuffle; a
        row counts its url once however often it is fetched.
        """
        before, number = self.kept.live(), self.kept.next()
        lines = self.kept.write(number, "lines", keyed_lines(docs))
        new = lines.where(F.col("url_key").isNotNull()).select("source", "k1", "k2", "url_key").distinct()
        if before:
            old = self._read("lines", self.LINES, before).select("source", "k1", "k2", "url_key")
            new = new.join(old, _same(new, old, "k1", "k2", "url_key"), "left_anti")
        delta = new.groupBy("source", "k1", "k2").agg(F.count("*").alias("n_new"))
        if before:
            old = self.counts().withColumnRenamed("n_urls", "was")
            delta = delta.join(old, _same(delta, old, "k1", "k2"), "left").select(delta["source"], delta["k1"], delta["k2"], "n_new", F.coalesce("was", F.lit(0)).cast("long").alias("was"))
        else:
            delta = delta.withColumn("was", F.lit(0).cast("long"))
        counts = self.kept.write(number, "counts", delta.select("source", "k1", "k2", (F.col("n_new") + F.col("was")).alias("n_urls"), "was"))
        self.kept.commit(number, [*before, number])
        return counts.where((F.col("n_urls") >= self.min_urls) & (F.col("was") < self.min_urls)).select("source", "k1", "k2")

    def flagged(self) -> DataFrame:
        """(row_id, line_no) of every repeated line of every delta, from the stored keys; a row that came in several
        deltas counts once."""
        numbers = self.kept.live()
        found = _marked(self._read("lines", self.LINES, numbers), self.repeated())
        return found if len(numbers) < 2 else found.distinct()

    def to_rebuild(self, crossed: DataFrame) -> DataFrame:
        """(row_id) of the documents that the last delta changes: its own that have a repeated line, and earlier ones
        that have one of ``crossed``."""
        numbers = self.kept.live()
        own = _marked(self._read("lines", self.LINES, numbers[-1:]), self.repeated()).select("row_id")
        earlier = _marked(self._read("lines", self.LINES, numbers[:-1]), crossed).select("row_id")
        return own.unionByName(earlier).distinct()

    def rebuild(self, docs: DataFrame, crossed: DataFrame) -> DataFrame:
        """(row_id, content) of the documents of ``to_rebuild`` out of ``docs``, all repeated lines taken out."""
        rows = cut(self.to_rebuild(crossed), "stale").withColumnRenamed("row_id", "s_row")
        flagged = self.flagged()
        flagged = flagged.join(rows, F.col("row_id") == F.col("s_row"), "left_semi")
        return drop_lines(docs.join(rows, F.col("row_id") == F.col("s_row"), "left_semi"), flagged)


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    test = a["source"].eqNullSafe(b["source"])
    for k in keys:
        test = test & (a[k] == b[k])
    return test


def _marked(lines: DataFrame, keys: DataFrame) -> DataFrame:
    marks = keys.select(F.col("source").alias("r_source"), F.col("k1").alias("r_k1"), F.col("k2").alias("r_k2"))
    match = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("k1") == F.col("r_k1")) & (F.col("k2") == F.col("r_k2"))
    return lines.join(marks, match, "left_semi").select("row_id", "line_no")


def flag_lines(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(row_id, line_no) of every line of ``docs``, of no delta yet, whose wording is in ``repeated``."""
    return _marked(keyed_lines(docs), repeated)


def drop_lines(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """(row_id, content) of every row: the lines in ``flagged`` taken out, the rest as they were.

    NULL and empty contents pass unchanged. Only the short list of line numbers is shuffled to the
    rows, never the lines; one text's list is bounded by its own length.
    """
    gone = flagged.groupBy(F.col("row_id").alias("g_row")).agg(F.collect_set("line_no").alias("gone"))
    joined = docs.select("row_id", "content").join(gone, F.col("row_id") == F.col("g_row"), "left")
    lines = F.split("content", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.col("gone"), (i + 1).cast("long")))
    content = F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))
    return joined.select("row_id", content.alias("content"))
