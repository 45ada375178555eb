"""The engine's surface: index documents, answer sparse, dense, hybrid and fallback queries.

Every search takes a table of queries (query_id, q, k) or one text, and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import key_terms, query_variants
from ..operators import chunker, dense, fallback, hybrid, index, sparse
from ..sources.files import read_jsonl, write_jsonl
from ..sources.pages import extract_articles
from ..operators.crawl import crawl
from . import answers
from ..session import cut


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, embed=dense.hashing_embedding):
        self.spark, self.settings, self.embed = spark, settings or Settings(), embed
        self.index: index.InvertedIndex | None = None
        self.vectors: DataFrame | None = None

    def queries(self, q: str | DataFrame, k: int | None = None) -> DataFrame:
        if isinstance(q, DataFrame):
            return q
        return self.spark.createDataFrame([(0, q, self.settings.top_k if k is None else k)], "query_id BIGINT, q STRING, k INT")

    def acquire(self, pages: DataFrame, seeds: DataFrame, robots: DataFrame, path: str, max_pages: int = 50, max_depth: int = 3, valid=None) -> DataFrame:
        """Crawl, extract, append to a JSON-lines folder; the articles."""
        found = crawl(pages, seeds, robots, max_depth, max_pages, self.settings.user_agent, valid)
        articles = extract_articles(pages.join(found.select(F.col("url").alias("f_url")), F.col("url") == F.col("f_url"), "left_semi"), self.settings)
        write_jsonl(articles, path)
        return read_jsonl(self.spark, path)

    def index_documents(self, docs: DataFrame, path: str | None = None, order: str | list[str] | None = None) -> index.InvertedIndex:
        """Upsert ``docs`` into the index under ``path``, by ``doc_id`` where they have one, else by url; of rows with one
        key the last by ``order`` wins, without one the last read."""
        store = self._store(path)
        store.upsert(index.index_document(docs), "doc_id" if "doc_id" in docs.columns else "url", order)
        return self.refresh()

    def delete(self, keys: DataFrame, path: str | None = None) -> index.InvertedIndex:
        """Delete the documents of ``keys`` (doc_id)."""
        self._store(path).delete(keys)
        return self.refresh()

    def refresh(self) -> index.InvertedIndex:
        """Make the last commit of the index visible, whoever wrote it."""
        self.index = self._documents.index()
        return self.index

    def _store(self, path: str | None) -> index.IndexStore:
        if path is not None and path != getattr(self, "_index_path", None):
            self._index_path, self._documents = path, index.IndexStore(self.spark, path, self.settings)
        if getattr(self, "_documents", None) is None:
            raise ValueError("no index folder has been named yet")
        return self._documents

    def open(self, index_path: str | None = None, vector_path: str | None = None) -> Engine:
        """Go on with an index and a vector collection that are there already."""
        if index_path:
            self._store(index_path)
            self.refresh()
        if vector_path:
            self._vector_store(vector_path)
        return self

    def _vector_store(self, path: str | None) -> dense.VectorStore:
        if path is not None:
            self._vectors = dense.VectorStore(self.spark, path)
        self.vectors = self._vectors.rows()
        return self._vectors

    def index_vectors(self, docs: DataFrame, path: str | None = None) -> int:
        """Chunk and embed ``docs``, add the chunks whose id is new; the number of chunks made."""
        made = Observation("chunks")
        self.add_chunks(chunker.chunk(docs, self.settings).observe(made, F.count("*").alias("n")), path)
        return made.get["n"]

    def embedded(self, chunks: DataFrame) -> DataFrame:
        """Rows of a vector collection from chunks (id, content, metadata)."""
        meta = {c: F.col(f"metadata.{c}") for c in ("doc_id", "title", "source")}
        return chunks.select("id", "content", *[v.alias(k) for k, v in meta.items()], F.col("metadata.publication_date").alias("date"), self.embed("content").alias("embedding"))

    def add_chunks(self, chunks: DataFrame, path: str | None = None) -> None:
        """Embed chunks and add those whose id is new."""
        self._vector_store(path).add(self.embedded(chunks))
        self._vector_store(None)

    def delete_vectors(self, ids: DataFrame, path: str | None = None) -> None:
        self._vector_store(path).delete(ids)
        self._vector_store(None)

    def sparse(self, q: str | DataFrame, k: int | None = None) -> DataFrame:
        return sparse.search(self.index, self.queries(q, k), self.settings)

    def dense(self, q: str | DataFrame, k: int | None = None, filters: dict | None = None) -> DataFrame:
        asked = self.queries(q, k)
        most = asked.agg(F.max("k")).first()[0] or 0
        near = self._near(asked, max(1, most), filters)
        near = near.join(asked.select(F.col("query_id").alias("a_query"), "k"), F.col("query_id") == F.col("a_query")).where(F.col("rank") <= F.col("k")).drop("a_query", "k")
        return dense.dense_results(near, self.vectors)

    def _near(self, asked: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
        where = dense.where_filter(filters) if filters else None
        return dense.knn(self.vectors, asked.select("query_id", self.embed("q").alias("embedding")), k, "l2", where)

    def hybrid(self, q: str | DataFrame, k: int | None = None, fuse_on: str = "id") -> DataFrame:
        """Both legs give their best ``top_candidates``; fused by reciprocal ranks."""
        asked = self.queries(q, k)
        deep = asked.withColumn("k", F.lit(self.settings.top_candidates))
        left = sparse.search(self.index, deep, self.settings)
        right = dense.dense_results(self._near(asked, self.settings.top_candidates), self.vectors)
        most = asked.agg(F.max("k")).first()[0] or 0
        fused = hybrid.fuse(left, right.withColumn("doc_id", F.col("url")), most, self.settings.rrf_k, fuse_on)
        fused = fused.join(asked.select(F.col("query_id").alias("a_query"), "k"), F.col("query_id") == F.col("a_query")).where(F.col("rank") <= F.col("k")).drop("a_query", "k")
        return hybrid.hybrid_results(fused, left, right)

    def search_with_fallback(self, q: str | DataFrame, feed: DataFrame, k: int | None = None, store: bool = False) -> DataFrame:
        """Local results, and the feed's for queries without enough of them. With ``store`` the feed rows that were used
        are indexed under their short ids once the answer is written."""
        asked = self.queries(q, k)
        local = self.sparse(asked)
        if store:
            local = cut(local, "local")
        found = fallback.search_with_fallback(asked, local, feed, self.settings)
        if store:
            found = cut(found, "answer")
            self.index_documents(fallback.feed_documents(fallback.used_feed(asked, local, feed, self.settings)), order=["date", "title"])
        return found

    def answer(self, way: str, q: str, k: int | None = None) -> dict:
        """{"query", "results"} of one search, ``way`` being sparse, dense or hybrid."""
        return answers.answer(self, way, q, self.settings.top_k if k is None else k)

    def suggestions(self, q: str | DataFrame) -> DataFrame:
        return self.queries(q).select("query_id", F.col("q").alias("original_query"), query_variants(F.col("q")).alias("variants"), key_terms(F.col("q")).alias("key_terms"))

    def statistics(self) -> DataFrame:
        return index.model_stats(self.index, self.settings.mu)

    def count(self) -> int:
        return self.index.docs.count()

    def documents(self) -> DataFrame:
        return self.index.docs.select("doc_id", "url", "title", "content", "source").orderBy("doc_id")
