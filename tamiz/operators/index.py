"""Document index: upsert and delete by key, inverted index and statistics, kept as generations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import analysis
from .generations import Generations, newest

COMPACT_AFTER = 16  # generations; a commit beyond them is followed by a merge


def index_document(raw: DataFrame) -> DataFrame:
    """Raw to index documents: a NULL title or content becomes '', NULL authors an empty array."""
    return raw.select(
        "source",
        "url",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"),
        *[c for c in raw.columns if c not in ("source", "url", "title", "content", "authors")],
    )


def latest(rows: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """One row a key: the first by ``newest_first``. Each task keeps its own first row of a key before the shuffle."""
    order = Window.partitionBy(key).orderBy(*newest_first)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1).drop("__r")


def last_arrived(rows: DataFrame, key: str, order: str | list[str] | None = None) -> DataFrame:
    """One row a key: the last by ``order``, or without one the last in the order in which ``rows`` are read.
    Rows without a key are left out."""
    rows = rows.where(F.col(key).isNotNull())
    if order is None:
        return latest(rows.withColumn("__at", F.monotonically_increasing_id()), key, F.desc("__at")).drop("__at")
    return latest(rows, key, *[F.desc_nulls_last(c) for c in ([order] if isinstance(order, str) else order)])


def upsert(table: DataFrame, rows: DataFrame, key: str = "url", order: str | None = None) -> DataFrame:
    """``table`` with each of ``rows`` in place of the row of its key; of rows with one key the last wins."""
    rows = last_arrived(rows, key, order)
    return delete_by_key(table, rows, key).unionByName(rows, allowMissingColumns=True)


def delete_by_key(table: DataFrame, keys: DataFrame, key: str = "url") -> DataFrame:
    gone = keys.select(F.col(key).alias("__gone")).distinct()
    return table.join(gone, F.col(key) == F.col("__gone"), "left_anti")


@dataclass(frozen=True)
class InvertedIndex:
    """The tables of one snapshot."""

    docs: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    settings: Settings = Settings()

    def save(self, path: str) -> InvertedIndex:
        """Index ``docs`` into a store under ``path`` and read it back."""
        store = IndexStore(self.docs.sparkSession, path, self.settings)
        store.upsert(self.docs, key="doc_id")
        return store.index()


def analysed(docs: DataFrame, settings: Settings) -> DataFrame:
    """``docs`` with ``words``, the words of the content that count, in order, and their number ``dl``."""
    with_words = docs.withColumn("words", analysis.kept_words(F.col("content"), settings.analyzer))
    return with_words.withColumn("dl", F.size("words").cast("long"))


def counted_terms(docs: DataFrame, settings: Settings) -> DataFrame:
    """(term, doc_id, tf, dl) of analysed documents; stemmed word by word, and counted in the reading task before the shuffle."""
    rows = docs.select("doc_id", "dl", F.explode("words").alias("word"))
    term = F.col("word") if settings.analyzer == "simple" else analysis.stem(F.col("word"))
    rows = rows.select("doc_id", "dl", term.alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")).select("term", "doc_id", "tf", "dl")


def build_index(docs: DataFrame, settings: Settings = Settings()) -> InvertedIndex:
    """Index ``docs`` (doc_id, url, title, content, source, ...), one row a doc_id, as a plan without a store.

    A '' or NULL content gives a document of length 0.
    """
    ready = analysed(docs, settings)
    postings, doc_stats = counted_terms(ready, settings), ready.select("doc_id", "dl")
    totals = doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens"))
    by_term = postings.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return InvertedIndex(docs, postings, doc_stats, *_statistics(by_term, totals), settings)


def _statistics(by_term: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Term and corpus statistics from (term, cf, df) and one row (n_docs, total_tokens)."""
    term_stats = by_term.crossJoin(F.broadcast(totals)).select("term", "cf", "df", (F.col("cf") / F.col("total_tokens")).alias("p_wc"))
    n_terms = by_term.agg(F.count("*").alias("n_terms"))
    average = F.coalesce(F.try_divide("total_tokens", "n_docs"), F.lit(0.0))
    return term_stats, totals.crossJoin(n_terms).select("n_docs", "n_terms", "total_tokens", average.alias("avg_dl"))


class IndexStore:
    """The index under one folder. An upsert or delete writes a generation: its own documents with their words, its
    postings, the ids it deletes, and the signed change of the statistics. Older rows of the same ids stop counting;
    ``compact`` drops them. A new store on an old folder goes on from its last commit."""

    TERMS = "term STRING, cf BIGINT, df BIGINT"
    TOTALS = "n_docs BIGINT, total_tokens BIGINT"

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.settings, self.kept = spark, settings, Generations(spark, path)

    def upsert(self, rows: DataFrame, key: str = "url", order: str | list[str] | None = None) -> int:
        """Put ``rows`` in place of the documents of their keys; of rows with one key the last by ``order`` wins, without
        one the last read. ``doc_id`` is the key's value. The number of the commit."""
        rows = rows.withColumn("doc_id", F.col(key)) if "doc_id" not in rows.columns or key != "doc_id" else rows
        number, before = self.kept.next(), self.kept.live()
        # texts are analysed here and nowhere else
        docs = self.kept.write(number, "docs", analysed(last_arrived(rows, "doc_id", order), self.settings))
        self._write_postings(number, docs)
        self._write_changes(number, before, docs)
        return self._publish(number, before)

    def delete(self, keys: DataFrame, key: str = "doc_id") -> int:
        """Delete the documents of ``keys``; unknown keys change nothing. The number of the commit."""
        number, before = self.kept.next(), self.kept.live()
        self.kept.write(number, "deleted", keys.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id")).distinct())
        self._write_changes(number, before, None)
        return self._publish(number, before)

    def _write_postings(self, number: int, docs: DataFrame) -> None:
        # a common term spreads over ranges of documents; a query's terms prune files and row groups
        postings = counted_terms(docs, self.settings).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
        self.kept.write(number, "postings", postings)

    def _write_changes(self, number: int, before: list[int], docs: DataFrame | None) -> None:
        sums = [F.sum("cf").alias("cf"), F.sum("df").alias("df")]
        terms, totals = [], []
        if docs is not None:
            own = self.kept.read("postings", [number])
            terms.append(own.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")))
            totals.append(docs.select(F.lit(1).alias("n"), "dl"))
        if before:
            # what goes is read from the documents' own words, not from all postings
            changed = docs.select("doc_id") if docs is not None else self.kept.read("deleted", [number], "doc_id STRING").select("doc_id")
            gone = self._documents(before).join(changed.select(F.col("doc_id").alias("__c")), F.col("doc_id") == F.col("__c"), "left_semi")
            terms.append(counted_terms(gone, self.settings).groupBy("term").agg((-F.sum("tf")).alias("cf"), (-F.count("*")).alias("df")))
            totals.append(gone.select(F.lit(-1).alias("n"), (-F.col("dl")).alias("dl")))
        if terms:
            self.kept.write(number, "terms", reduce(DataFrame.unionByName, terms).groupBy("term").agg(*sums))
            total = reduce(DataFrame.unionByName, totals).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_tokens"))
            self.kept.write(number, "totals", total)

    def _publish(self, number: int, before: list[int]) -> int:
        self.kept.commit(number, [*before, number])
        if len(before) + 1 > COMPACT_AFTER:
            return self.compact()
        return number

    def _newer(self, numbers: list[int]) -> DataFrame | None:
        """(doc_id, gen) that later generations write or delete."""
        later = numbers[1:]
        found = [t.select("doc_id", "gen") for t in (self.kept.read("docs", later), self.kept.read("deleted", later, "doc_id STRING")) if t is not None]
        return reduce(DataFrame.unionByName, found) if found else None

    def _documents(self, numbers: list[int]) -> DataFrame:
        docs = self.kept.read("docs", numbers)
        if docs is None:
            return self.spark.createDataFrame([], "doc_id STRING, url STRING, title STRING, content STRING, source STRING, words ARRAY<STRING>, dl BIGINT, gen INT")
        return newest(docs, self._newer(numbers), "doc_id")

    def index(self) -> InvertedIndex:
        """The index as of the last commit."""
        numbers = self.kept.live()
        docs = self._documents(numbers)
        postings = self.kept.read("postings", numbers, "term STRING, doc_id STRING, tf BIGINT, dl BIGINT")
        terms, totals = self.kept.read("terms", numbers, self.TERMS), self.kept.read("totals", numbers, self.TOTALS)
        if postings is None:
            postings = self.spark.createDataFrame([], "term STRING, doc_id STRING, tf BIGINT, dl BIGINT")
            terms, totals = (self.spark.createDataFrame([], t) for t in (self.TERMS, self.TOTALS))
        else:
            postings = newest(postings, self._newer(numbers), "doc_id").drop("gen")
        if len(numbers) > 1:
            terms = terms.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).where(F.col("df") > 0)
        totals = totals.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))
        return InvertedIndex(docs.drop("words", "dl", "gen"), postings, docs.select("doc_id", "dl"), *_statistics(terms.select("term", "cf", "df"), totals), self.settings)

    def compact(self) -> int:
        """Merge all generations into one: live documents and postings as they are, statistics summed."""
        number, numbers = self.kept.next(), self.kept.live()
        found = self.index()
        self.kept.write(number, "docs", self._documents(numbers).drop("gen"))
        self.kept.write(number, "postings", found.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
        self.kept.write(number, "terms", found.term_stats.select("term", "cf", "df"))
        self.kept.write(number, "totals", found.corpus_stats.select("n_docs", "total_tokens"))
        self.kept.commit(number, [number])
        return number


def term_frequency(index: InvertedIndex, doc_ids: DataFrame, term: str, mode: str = "spanish") -> DataFrame:
    """(doc_id, tf) of one word in each of ``doc_ids``, 0 where it does not stand."""
    spark = doc_ids.sparkSession
    wanted = spark.createDataFrame([(term,)], "word STRING").select(F.explode(analysis.analyze(F.col("word"), mode)).alias("q_term"))
    found = index.postings.join(F.broadcast(wanted), F.col("term") == F.col("q_term")).select(F.col("doc_id").alias("p_doc"), "tf")
    joined = doc_ids.select("doc_id").join(found, F.col("doc_id") == F.col("p_doc"), "left")
    return joined.select("doc_id", F.coalesce("tf", F.lit(0).cast("long")).alias("tf"))


def model_stats(index: InvertedIndex, mu: float) -> DataFrame:
    return index.corpus_stats.withColumn("mu", F.lit(mu))


def term_statistics(index: InvertedIndex, terms: DataFrame) -> DataFrame:
    """(term, cf, df, p_wc, n_docs) of ``terms`` (term), zeros for an unknown one."""
    found = index.term_stats.withColumnRenamed("term", "t_term")
    rows = terms.join(found, F.col("term") == F.col("t_term"), "left").crossJoin(F.broadcast(index.corpus_stats.select("n_docs")))
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
    return rows.select("term", zero("cf", "long"), zero("df", "long"), zero("p_wc", "double"), "n_docs")
