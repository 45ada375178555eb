"""Language-model ranking: candidates by BM25, query likelihood with Dirichlet smoothing, scores 0 to 100.

A query is a row of ``queries`` (query_id, q, k), so one plan answers one query or many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import analysis, scoring
from ..functions.text import snippet
from .index import InvertedIndex


def query_terms(queries: DataFrame, mode: str = "spanish", again: bool = False) -> DataFrame:
    """(query_id, term, qtf); ``again`` analyses the terms a second time, as the candidates' match does.
    A blank query has no rows."""
    terms = analysis.analyze(F.col("q"), mode)
    if again:
        terms = analysis.analyze_again(terms, mode)
    return queries.select("query_id", F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def matches(index: InvertedIndex, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, doc_id, bm25) of every document with at least one query term in its content."""
    asked = query_terms(queries, settings.analyzer, again=True)
    hit = index.postings.join(asked, "term").join(index.term_stats.select("term", "df"), "term").crossJoin(F.broadcast(index.corpus_stats.select("n_docs", "avg_dl")))
    part = scoring.bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n_docs"), F.col("avg_dl"), settings.bm25_k1, settings.bm25_b)
    return hit.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * part).alias("bm25"))


def candidates(index: InvertedIndex, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, doc_id, bm25, cand_rank) of each query's best ``top_candidates`` matches, ties by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "doc_id")
    ranked = matches(index, queries, settings).withColumn("cand_rank", F.row_number().over(order))
    return ranked.where(F.col("cand_rank") <= settings.top_candidates)


def term_grid(index: InvertedIndex, queries: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, doc_id, cand_rank, term, qtf, tf, dl, p_wc, p): every candidate with every query term.

    At most ``top_candidates`` rows a query and term, whatever the collection's size.
    """
    asked = query_terms(queries, settings.analyzer)
    grid = found.select("query_id", "doc_id", "cand_rank").join(asked, "query_id")
    # only postings of the queries' terms meet the grid
    terms = asked.select(F.col("term").alias("a_term")).distinct()
    held = index.postings.join(terms, F.col("term") == F.col("a_term"), "left_semi").select(F.col("term").alias("p_term"), F.col("doc_id").alias("p_doc"), "tf")
    grid = grid.join(held, (F.col("term") == F.col("p_term")) & (F.col("doc_id") == F.col("p_doc")), "left").drop("p_term", "p_doc")
    grid = grid.join(index.doc_stats.withColumnRenamed("doc_id", "d_doc"), F.col("doc_id") == F.col("d_doc"), "left").drop("d_doc")
    grid = grid.join(index.term_stats.select(F.col("term").alias("t_term"), "p_wc"), F.col("term") == F.col("t_term"), "left").drop("t_term")
    grid = grid.withColumn("tf", F.coalesce("tf", F.lit(0).cast("long"))).withColumn("p_wc", F.coalesce("p_wc", F.lit(0.0)))
    return grid.withColumn("p", scoring.dirichlet(F.col("tf"), F.col("p_wc"), F.col("dl"), settings.mu))


def likelihoods(index: InvertedIndex, queries: DataFrame, settings: Settings = Settings(), oov: str = "reference") -> DataFrame:
    """(query_id, doc_id, cand_rank, log_score) of every candidate.

    A query term that the collection lacks sinks all candidates to the floor, as long as ``oov`` is
    "reference"; "skip" leaves such terms out. A repeated term counts as often as it stands.
    """
    grid = term_grid(index, queries, candidates(index, queries, settings), settings)
    if oov == "skip":
        grid = grid.where(F.col("p_wc") > 0)
    return grid.groupBy("query_id", "doc_id", "cand_rank").agg(scoring.log_likelihood(F.col("p"), F.col("qtf")).alias("log_score"))


def ranked(index: InvertedIndex, queries: DataFrame, settings: Settings = Settings(), oov: str = "reference") -> DataFrame:
    """(query_id, doc_id, cand_rank, log_score, score, rank) of every candidate; the score is 0 to 100 between the
    worst and the best candidate, and 0 for all where they are equal. Ties keep the candidates' order."""
    by_query = Window.partitionBy("query_id")
    scored = likelihoods(index, queries, settings, oov)
    scored = scored.withColumn("low", F.min("log_score").over(by_query)).withColumn("high", F.max("log_score").over(by_query))
    scored = scored.withColumn("score", scoring.min_max_100(F.col("log_score"), F.col("low"), F.col("high")))
    order = by_query.orderBy(F.desc(F.round("log_score", 9)), "cand_rank")
    return scored.withColumn("rank", F.row_number().over(order)).drop("low", "high")


def search(index: InvertedIndex, queries: DataFrame, settings: Settings = Settings(), oov: str = "reference") -> DataFrame:
    """(query_id, rank, id, url, title, content, source, score, snippet): each query's best k."""
    top = ranked(index, queries, settings, oov).join(queries.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k"))
    docs = index.docs.select(F.col("doc_id").alias("d_id"), "url", "title", "content", "source")
    joined = top.join(docs, F.col("doc_id") == F.col("d_id"))
    return joined.select("query_id", "rank", F.col("doc_id").alias("id"), "url", "title", "content", "source", "score", snippet(F.col("content")).alias("snippet"))


def explain(index: InvertedIndex, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, doc_id, dl, mu, log_score, probability, terms): each candidate's score, term by term."""
    grid = term_grid(index, queries, candidates(index, queries, settings), settings)
    log_p = F.when(F.col("p") > 0, F.log("p"))
    part = F.struct("term", "tf", F.col("p_wc").alias("p_w_c"), F.col("p").alias("p_w_d"), log_p.alias("log_p_w_d"))
    rows = grid.groupBy("query_id", "doc_id").agg(
        F.first("dl").alias("dl"), scoring.log_likelihood(F.col("p"), F.col("qtf")).alias("log_score"), F.sort_array(F.collect_list(part)).alias("terms")
    )
    probability = F.when(F.col("log_score") <= scoring.FLOOR, 0.0).otherwise(F.exp("log_score"))
    return rows.select("query_id", "doc_id", "dl", F.lit(settings.mu).alias("mu"), "log_score", probability.alias("probability"), "terms")
