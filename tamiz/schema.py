"""Table schemas, as DDL."""

DOCUMENT = "source STRING, url STRING, title STRING, content STRING, authors ARRAY<STRING>, date TIMESTAMP"
JSONL = "source STRING, url STRING, title STRING, authors ARRAY<STRING>, published_date STRING, content STRING"
CHUNK = (
    "id STRING, content STRING, metadata STRUCT<doc_id: STRING, source: STRING, title: STRING, publication_date: STRING, "
    "authors: ARRAY<STRING>, chunk_number: INT, estimated_tokens: INT>"
)
POSTING = "term STRING, doc_id STRING, tf BIGINT, dl BIGINT"
DOC_STATS = "doc_id STRING, dl BIGINT"
TERM_STATS = "term STRING, cf BIGINT, df BIGINT, p_wc DOUBLE"
CORPUS_STATS = "n_docs BIGINT, n_terms BIGINT, total_tokens BIGINT, avg_dl DOUBLE"
RESULT = "query_id BIGINT, rank INT, id STRING, url STRING, title STRING, source STRING, date TIMESTAMP, score DOUBLE, snippet STRING"
FEED = "title STRING, link STRING, published TIMESTAMP, summary STRING, source STRING"
VECTOR = "id STRING, embedding ARRAY<FLOAT>, document STRING, metadata MAP<STRING, STRING>"
FRONTIER = "url STRING, depth INT, seq BIGINT"
PAGE = "url STRING, html STRING"
