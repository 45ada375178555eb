"""The registered queries of the core: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles, oracles_web, queries_web
from .config import Settings
from .functions import analysis, dates
from .functions import text as T
from .operators import chunker, crawl, dense, fallback, hybrid, index, sparse
from .operators.timestamps import InstantDictionary, site_zones
from .plans import answers
from .plans.engine import Engine
from .session import cut, work_dir
from .sources.pages import long_enough, scraper_of

SETTINGS = Settings()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The UTC instant of every record whose date text names exactly one."""
    sites = table(spark, folder, "sites")
    docs = table(spark, folder, "search_documents").select(
        F.lit("search_documents").alias("tbl"), F.col("row_id").cast("string").alias("rec_key"), F.col("date").alias("raw"), "source"
    )
    chunks = table(spark, folder, "chunks").select(
        F.lit("chunks").alias("tbl"), F.col("id").alias("rec_key"), F.col("metadata.publication_date").alias("raw"), F.col("metadata.source").alias("source")
    )
    chunks = chunks.dropDuplicates(["rec_key"])
    dictionary = InstantDictionary(spark, work_dir(spark, "instants"))
    found = []
    for records in (docs, chunks):
        records = site_zones(records, sites)
        dictionary.update(records)
        found.append(records)
    return dictionary.resolve(found[0].unionByName(found[1])).select("tbl", "rec_key", "instant_us")


# The indexed collection: the latest fetch of each url of search_documents, under its url.


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    rows = index.last_arrived(table(spark, folder, "search_documents"), "url", ["fetched_at", "row_id"])
    return index.index_document(rows).withColumn("doc_id", F.col("url"))


_built: dict[tuple, index.IndexStore] = {}
_embedded: dict[tuple, dense.VectorStore] = {}


def _version(spark: SparkSession, folder: str, name: str) -> tuple:
    """What stands for one state of a table in this session."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return spark.sparkContext.applicationId, status.getPath().toString(), status.getModificationTime(), status.getLen()


def _new_index(spark: SparkSession, folder: str) -> index.IndexStore:
    store = index.IndexStore(spark, work_dir(spark, "index"), SETTINGS)
    store.upsert(index.index_document(table(spark, folder, "search_documents")), "url", ["fetched_at", "row_id"])
    return store


def _index(spark: SparkSession, folder: str) -> index.InvertedIndex:
    """The index of all documents: built by the first query of a session that needs it, read by the others."""
    version = _version(spark, folder, "search_documents")
    if version not in _built:
        _built[version] = _new_index(spark, folder)
    return _built[version].index()


def _engine(spark: SparkSession, folder: str) -> Engine:
    """An engine over that index and over the chunks, embedded once a session like it."""
    engine = Engine(spark, SETTINGS)
    engine.index = _index(spark, folder)
    version = _version(spark, folder, "chunks")
    if version not in _embedded:
        _embedded[version] = dense.VectorStore(spark, work_dir(spark, "vectors"))
        _embedded[version].add(engine.embedded(table(spark, folder, "chunks")))
    engine.vectors = _embedded[version].rows()
    return engine


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_queries")


def _r(column, places: int = 6):
    return F.round(column, places)


def token_counts(spark, folder):
    """Postings of a new index: what building it costs."""
    return _new_index(spark, folder).index().postings.select("doc_id", "term", "tf")


def _deltas(spark, folder) -> index.IndexStore:
    """An index of the even rows, then the odd ones by given ids, some of them urls, without the feed's urls."""
    rows = index.index_document(table(spark, folder, "search_documents"))
    store = index.IndexStore(spark, work_dir(spark, "index"), SETTINGS)
    store.upsert(rows.where(F.col("row_id") % 2 == 0), "url", ["fetched_at", "row_id"])
    own = F.when(F.col("row_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("d"), (F.col("row_id") % 100).cast("string")))
    store.upsert(rows.where(F.col("row_id") % 2 == 1).withColumn("doc_id", own), "doc_id", "row_id")
    store.delete(table(spark, folder, "feed_items").select(F.col("link").alias("doc_id")))
    return store


def index_deltas(spark, folder):
    """Term statistics after two upserts and a delete."""
    return _deltas(spark, folder).index().term_stats.select("term", "cf", "df", _r("p_wc", 12).alias("p_wc"))


def index_compacted(spark, folder):
    """Postings after the same and a merge of all generations."""
    store = _deltas(spark, folder)
    store.compact()
    return store.index().postings


def doc_lengths(spark, folder):
    return _index(spark, folder).doc_stats


def term_collection_stats(spark, folder):
    return _index(spark, folder).term_stats.select("term", "cf", "df", _r("p_wc", 12).alias("p_wc"))


def model_stats(spark, folder):
    got = index.model_stats(_index(spark, folder), SETTINGS.mu)
    return got.select("n_docs", "n_terms", "total_tokens", _r("avg_dl").alias("avg_dl"), "mu")


def term_stats(spark, folder):
    asked = sparse.query_terms(_asked(spark, folder)).select("term").distinct()
    return index.term_statistics(_index(spark, folder), asked).withColumn("p_wc", _r("p_wc", 12))


def term_frequency_lookup(spark, folder):
    found = _index(spark, folder)
    return index.term_frequency(found, found.doc_stats, "acuerdo")


def simple_tokens(spark, folder):
    """Words of every text of documents, without analysis, counted."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.explode(analysis.words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def stemmed_terms(spark, folder):
    docs = table(spark, folder, "documents")
    words = docs.select(F.explode(analysis.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", analysis.stem(F.col("word")).alias("stem"))


def stop_filtered_tokens(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.size(analysis.words(F.col("text"))).cast("long").alias("n_words"), F.size(analysis.analyze(F.col("text"))).cast("long").alias("n_terms"))


def candidates_or(spark, folder):
    return sparse.matches(_index(spark, folder), _asked(spark, folder), SETTINGS).select("query_id", "doc_id")


def bm25_top200(spark, folder):
    got = sparse.candidates(_index(spark, folder), _asked(spark, folder), SETTINGS)
    return got.select("query_id", "doc_id", _r("bm25").alias("bm25"), F.col("cand_rank").cast("long").alias("cand_rank"))


def lmir_topk(spark, folder):
    """Sparse search of all queries: their best k with scores and snippets."""
    got = sparse.search(_index(spark, folder), _asked(spark, folder), SETTINGS)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "title", "source", _r("score", 4).alias("score"), "snippet")


def lmir_scores(spark, folder):
    got = sparse.ranked(_index(spark, folder), _asked(spark, folder), SETTINGS)
    return got.select("query_id", "doc_id", _r("log_score").alias("log_score"), _r("score", 4).alias("score"))


def lmir_explain(spark, folder):
    got = sparse.explain(_index(spark, folder), _asked(spark, folder), SETTINGS)
    parts = got.select("query_id", "doc_id", "dl", "mu", F.explode("terms").alias("t"))
    return parts.select("query_id", "doc_id", "dl", "mu", "t.term", "t.tf", _r("t.p_w_c", 12).alias("p_w_c"), _r("t.p_w_d", 9).alias("p_w_d"))


def _one_query(spark, q, k=10):
    return spark.createDataFrame([(1, q, k)], "query_id BIGINT, q STRING, k INT")


def lmir_oov_query(spark, folder):
    """A word that the collection lacks sinks every candidate to 0."""
    got = sparse.ranked(_index(spark, folder), _one_query(spark, "acuerdo xqzzyw"), SETTINGS)
    return got.select("doc_id", _r("log_score").alias("log_score"), _r("score").alias("score"))


def lmir_duplicate_terms(spark, folder):
    """A word said twice counts twice."""
    got = sparse.ranked(_index(spark, folder), _one_query(spark, "acuerdo acuerdo energía"), SETTINGS)
    return got.select("doc_id", _r("log_score").alias("log_score"))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _vector_queries(vectors):
    return vectors.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "embedding")


def _near(got):
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", _r("distance").alias("distance"))


def knn_l2(spark, folder):
    vectors = _vectors(spark, folder)
    return _near(dense.knn(vectors, _vector_queries(vectors), 10, "l2"))


def knn_cosine(spark, folder):
    vectors = _vectors(spark, folder)
    return _near(dense.knn(vectors, _vector_queries(vectors), 10, "cosine"))


def knn_filtered(spark, folder):
    vectors = _vectors(spark, folder)
    where = dense.where_filter({"$or": [{"label": {"$lt": 3}}, {"label": {"$in": [7, 8]}}]})
    return _near(dense.knn(vectors, _vector_queries(vectors), 10, "l2", where))


def knn_store(spark, folder):
    """Nearest by cosine over the vector store, dirty vectors and all (no SQL twin: ties of equal vectors)."""
    store = table(spark, folder, "vector_store").select(F.col("vec_id").alias("id"), "embedding")
    return _near(dense.knn(store, _vector_queries(store).where(F.size("embedding") == 64), 10, "cosine"))


def dense_results(spark, folder):
    """Neighbours with what they show."""
    vectors = _vectors(spark, folder)
    near = dense.knn(vectors, _vector_queries(vectors), 10, "l2")
    name = F.col("id").cast("string")
    payload = vectors.select("id", F.repeat(F.concat(F.lit("texto "), name), 30).alias("content"), F.concat(F.lit("u"), name).alias("doc_id"), F.concat(F.lit("Título "), name).alias("title"), F.col("label").cast("string").alias("source"))
    got = dense.dense_results(near, payload)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "url", "title", "source", _r("score").alias("score"), "snippet")


def vector_lifecycle(spark, folder):
    """A collection after two additions with common ids and a delete."""
    store = dense.VectorStore(spark, work_dir(spark, "vectors"))
    rows = table(spark, folder, "embeddings").select(F.col("vec_id"), F.col("vec_id").cast("string").alias("id"), "embedding")
    store.add(rows.where(F.col("vec_id") % 2 == 0).withColumn("title", F.lit("first")))
    store.add(rows.withColumn("title", F.lit("again")))
    store.delete(rows.where(F.col("vec_id") % 7 == 0).select("id"))
    return store.rows().select("id", "title", F.size("embedding").cast("long").alias("n"))


def vector_dimensions(spark, folder):
    return dense.dimensionality(table(spark, folder, "vector_store")).select(F.col("dimensions").cast("long").alias("dimensions"), "n")


def dense_search(spark, folder):
    """Nearest chunks of every query, text to answer."""
    got = _engine(spark, folder).dense(_asked(spark, folder))
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "url", "title", "source", "date", _r("score").alias("score"), "snippet")


def hybrid_search(spark, folder):
    """Both searches of every query, fused."""
    got = _engine(spark, folder).hybrid(_asked(spark, folder))
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "url", "title", "source", _r("score", 4).alias("score"), _r("rrf_score", 9).alias("rrf_score"), "snippet")


def api_answers(spark, folder):
    """Answers of the sparse search in the common form, item by item."""
    asked = _asked(spark, folder)
    got = answers.answers(asked, sparse.search(_index(spark, folder), asked, SETTINGS))
    items = got.select("query_id", "query", F.posexplode_outer("results").alias("pos", "item"))
    return items.select("query_id", "query", F.col("pos").cast("long").alias("pos"), "item.id", "item.title", "item.url", "item.source", "item.date", _r("item.score", 4).alias("score"), "item.snippet")


def _legs(spark, folder):
    """The model's ranking of documents, and the nearest 200 chunks, of each query."""
    engine, asked = _engine(spark, folder), _asked(spark, folder)
    left = sparse.ranked(engine.index, asked, SETTINGS).select("query_id", F.col("doc_id").alias("id"), "rank")
    near = engine._near(asked, SETTINGS.top_candidates)
    right = near.join(engine.vectors.select(F.col("id").alias("v_id"), "doc_id"), F.col("id") == F.col("v_id")).drop("v_id")
    return cut(left, "leg"), cut(right, "leg")


def rrf_fusion(spark, folder):
    got = hybrid.fuse(*_legs(spark, folder), k=10)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", _r("rrf_score", 9).alias("rrf_score"))


def rrf_fuse_doc(spark, folder):
    got = hybrid.fuse(*_legs(spark, folder), k=10, fuse_on="doc")
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "id", _r("rrf_score", 9).alias("rrf_score"))


def insufficiency_score(spark, folder):
    asked = _asked(spark, folder)
    local = sparse.search(_index(spark, folder), asked, SETTINGS)
    got = fallback.insufficiency_scores(asked, local, SETTINGS)
    return got.select("query_id", "n_results", _r("avg_score", 4).alias("avg_score"), _r("insufficiency_score").alias("insufficiency_score"), "triggered")


def _feed(spark, folder):
    """What a feed search would answer: the items whose title has a word of the query, best match first, then the newest."""
    items = table(spark, folder, "feed_items").distinct()
    words = items.select("title", "link", "published", "summary", "source", F.explode(F.array_distinct(analysis.words(F.col("title")))).alias("word"))
    asked = _asked(spark, folder).select("query_id", F.explode(F.array_distinct(analysis.words(F.col("q")))).alias("q_word")).where(F.length("q_word") > 3)
    met = words.join(F.broadcast(asked), F.col("word") == F.col("q_word")).groupBy("query_id", "title", "link", "published", "summary", "source").agg(F.count("*").alias("n"))
    fields = ["title", "link", "published", "summary", "source"]
    by_date = [F.desc_nulls_last("published"), F.asc_nulls_last("link"), F.asc_nulls_last("title"), F.asc_nulls_last("summary"), F.asc_nulls_last("source")]
    newest = items.orderBy(*by_date).limit(2 * SETTINGS.web_results_limit)
    others = _asked(spark, folder).select("query_id").distinct().crossJoin(F.broadcast(newest)).withColumn("n", F.lit(0).cast("long"))
    met = met.unionByName(others).groupBy("query_id", *fields).agg(F.max("n").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), *by_date)
    return met.withColumn("position", F.row_number().over(order)).where(F.col("position") <= 2 * SETTINGS.web_results_limit)


def fallback_combine(spark, folder):
    """Local results, and the feed's items for queries without enough of them."""
    asked = _asked(spark, folder)
    local = sparse.search(_index(spark, folder), asked, SETTINGS)
    got = fallback.search_with_fallback(asked, local, _feed(spark, folder), SETTINGS)
    return got.select("query_id", F.col("position").cast("long").alias("position"), "origin", "url", _r("score", 4).alias("score"))


def web_store(spark, folder):
    """The index after a search whose feed items were stored."""
    engine = Engine(spark, SETTINGS)
    engine.index_documents(table(spark, folder, "search_documents").drop("date"), work_dir(spark, "index"), ["fetched_at", "row_id"])
    engine.search_with_fallback(_asked(spark, folder), _feed(spark, folder), store=True)
    return engine.index.docs.select("doc_id", "url")


def web_short_ids(spark, folder):
    return fallback.feed_documents(table(spark, folder, "feed_items")).select("doc_id", "url", "title", "source")


def feed_results(spark, folder):
    return fallback.feed_results(table(spark, folder, "feed_items")).select("url", "title", "source", "score", "snippet")


def key_terms(spark, folder):
    return _asked(spark, folder).select("query_id", F.array_join(T.key_terms(F.col("q")), "|").alias("terms"))


def query_variants(spark, folder):
    return _asked(spark, folder).select("query_id", F.posexplode(T.query_variants(F.col("q"))).alias("pos", "variant")).select("query_id", F.col("pos").cast("long").alias("pos"), "variant")


def upsert_latest(spark, folder):
    """The documents of the index, of each url the last fetch."""
    found = _index(spark, folder).docs
    return found.select("url", "row_id", "title", F.length("content").cast("long").alias("n"), F.size("authors").cast("long").alias("n_authors"))


def delete_by_id(spark, folder):
    """The index without the urls that the feed has."""
    store = _new_index(spark, folder)
    store.delete(table(spark, folder, "feed_items").select(F.col("link").alias("doc_id")))
    return store.index().docs.select("url", "row_id")


def prefix_limit(spark, folder):
    """The first 10 documents by url, as a loader's limit takes them."""
    return _docs(spark, folder).orderBy("url").limit(10).select("url", "title")


def keyset_page(spark, folder):
    """The full scan in key order."""
    engine = Engine(spark, SETTINGS)
    engine.index = _index(spark, folder)
    return engine.documents().select("doc_id", "title", "content", "source")


def snippets(spark, folder):
    return _docs(spark, folder).select("url", T.snippet(F.col("content")).alias("snippet"), T.snippet_always(F.col("content")).alias("snippet_always"))


def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.clean_text(F.col("text")).alias("text"))


def clean_text_rules(spark, folder):
    """The cleaning rules without composition, which the SQL twin lacks."""
    return table(spark, folder, "documents").select("doc_id", T.clean_normalized(F.col("text")).alias("text"))


def source_names(spark, folder):
    return _docs(spark, folder).select("url", T.source_name(F.col("url")).alias("name"))


def url_filter(spark, folder):
    sites = ["malvenda.example", "torrubel.example", "corval.example"]
    return table(spark, folder, "feed_items").select("link").distinct().select("link", crawl.is_valid_url(F.col("link"), sites).alias("valid"))


def scraper_dispatch(spark, folder):
    known = {"www.malvenda.example": "rt", "www.torrubel.example": "bbc"}
    return _docs(spark, folder).groupBy(scraper_of(F.col("url"), known).alias("site")).agg(F.count("*").alias("n"))


def article_min_length(spark, folder):
    return _docs(spark, folder).where(long_enough(F.col("content"), SETTINGS.min_article_chars)).select("url")


def link_dedupe(spark, folder):
    """Feed items whose link the collection lacks, once a link."""
    items = table(spark, folder, "feed_items").where(F.col("link").isNotNull())
    return index.delete_by_key(items, _docs(spark, folder).select(F.col("url").alias("link")), "link").groupBy("link").agg(F.count("*").alias("n"))


def sentence_units(spark, folder):
    """Sentences of every content."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(chunker.sentences(t)))

    return _docs(spark, folder).select("url", count("content").alias("n_sentences"))


def chunks(spark, folder):
    docs = _docs(spark, folder)
    got = chunker.chunk(docs, SETTINGS)
    return got.select("id", "content", F.col("metadata.chunk_number").alias("chunk_number"), F.col("metadata.estimated_tokens").alias("estimated_tokens"))


def chunk_sizes(spark, folder):
    """Chunks of all documents by number and tokens."""
    got = chunker.chunk(_docs(spark, folder), SETTINGS)
    return got.select("id", F.col("metadata.doc_id").alias("doc_id"), F.col("metadata.chunk_number").cast("long").alias("chunk_number"), F.col("metadata.estimated_tokens").cast("long").alias("estimated_tokens"))


def chunk_count(spark, folder):
    """How many chunks indexing all documents makes, and how many the collection then has."""
    engine = Engine(spark, SETTINGS)
    made = engine.index_vectors(_docs(spark, folder), work_dir(spark, "vectors"))
    return engine.vectors.agg(F.count("*").alias("n_rows")).withColumn("n_made", F.lit(made).cast("long"))


def api_standardized(spark, folder):
    """Feed items as items of an answer: an empty id becomes the url, missing fields their defaults."""
    rows = table(spark, folder, "feed_items")
    some_id = F.when(F.length("title") % 2 == 0, F.col("title")).otherwise(F.lit(""))
    given = rows.select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), some_id.alias("id"), F.col("link").alias("url"), "source")
    return answers.standardized(given).drop("query_id", "rank")


def iso_dates(spark, folder):
    """Dates of the JSON-lines records in the extended ISO form, to the second or finer, impossible ones left out."""
    rows = table(spark, folder, "search_documents")
    iso = F.col("date").rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)?$")
    read = rows.where(iso).select("row_id", F.unix_micros(dates.parse_iso(F.col("date"))).alias("us"))
    return read.where(F.col("us").isNotNull())


def iso_dates_all(spark, folder):
    """Every record's date that parse_iso can read (no SQL twin: DuckDB casts other forms than ISO 8601 has)."""
    rows = table(spark, folder, "search_documents").select("row_id", F.unix_micros(dates.parse_iso(F.col("date"))).alias("us"))
    return rows.where(F.col("us").isNotNull())


_NAMES = [
    token_counts, index_deltas, index_compacted, doc_lengths, term_collection_stats, model_stats, term_stats, term_frequency_lookup, simple_tokens, stemmed_terms, stop_filtered_tokens,
    candidates_or, bm25_top200, lmir_topk, lmir_scores, lmir_explain, lmir_oov_query, lmir_duplicate_terms, knn_l2, knn_cosine, knn_filtered, knn_store,
    dense_results, vector_lifecycle, vector_dimensions, dense_search, hybrid_search, api_answers, rrf_fusion, rrf_fuse_doc, insufficiency_score, fallback_combine, web_store,
    web_short_ids, feed_results, key_terms, query_variants, upsert_latest, delete_by_id, prefix_limit, keyset_page, snippets, clean_text, clean_text_rules, source_names, url_filter,
    scraper_dispatch, article_min_length, link_dedupe, sentence_units, chunks, chunk_sizes, chunk_count, api_standardized, iso_dates, iso_dates_all,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found} | {f.__name__: f for f in _NAMES} | queries_web.register(table, _docs)

ORACLES: dict[str, str] = oracles.ORACLES | oracles_web.oracles(oracles.DOCS, oracles.NETLOC, oracles.TRIM, SETTINGS.min_article_chars)

FLAGSHIP = "lmir_topk"
