"""SQL twins of the core's queries, for DuckDB on the same tables."""

from __future__ import annotations

from .config import Settings
from .functions.analysis import STOP_WORDS
from .functions.text import KEY_TERM_STOP, VARIANT_ENDINGS
from .operators.chunker import ABBREVIATIONS, SPECIAL_TOKENS

_S = Settings()


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _stem(w: str) -> str:
    f = f"translate({w}, 'áàâäéèêëíìîïóòôöúùûü', 'aaaaeeeeiiiioooouuuu')"
    return (
        f"CASE WHEN length({w}) < 5 THEN {w} WHEN right({f}, 1) IN ('o', 'a', 'e') THEN left({f}, length({f}) - 1) "
        f"WHEN right({f}, 4) = 'eses' THEN left({f}, length({f}) - 2) WHEN right({f}, 3) = 'ces' THEN left({f}, length({f}) - 3) || 'z' "
        f"WHEN right({f}, 2) IN ('os', 'as', 'es') THEN left({f}, length({f}) - 2) ELSE {f} END"
    )


def _words(text: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}]+')"


DOCS = """docs AS (
  SELECT url AS doc_id, url, row_id, source, coalesce(title, '') AS title, coalesce(content, '') AS content, coalesce(authors, []) AS authors
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, row_id DESC) AS r FROM search_documents WHERE url IS NOT NULL) WHERE r = 1
)"""

INDEX = f"""{DOCS}, doc_words AS (
  SELECT doc_id, unnest({_words("content")}) AS w FROM docs
), doc_terms AS (
  SELECT doc_id, {_stem("w")} AS term FROM doc_words WHERE w NOT IN ({_in(STOP_WORDS)})
), doc_stats AS (
  SELECT d.doc_id, count(t.term) AS dl FROM docs d LEFT JOIN doc_terms t USING (doc_id) GROUP BY 1
), postings AS (
  SELECT term, doc_id, count(*) AS tf FROM doc_terms GROUP BY 1, 2
), corpus AS (
  SELECT count(*) AS n_docs, sum(dl) AS total_tokens, sum(dl) / count(*) AS avg_dl FROM doc_stats
), term_table AS (
  SELECT term, sum(tf) AS cf, count(*) AS df, sum(tf) / (SELECT total_tokens FROM corpus) AS p_wc FROM postings GROUP BY 1
)"""


def _asked(source: str) -> str:
    return f"""queries AS ({source}), query_words AS (
  SELECT query_id, unnest({_words("q")}) AS w FROM queries
), once AS (
  SELECT query_id, {_stem("w")} AS term FROM query_words WHERE w NOT IN ({_in(STOP_WORDS)})
), qt AS (SELECT query_id, term, count(*) AS qtf FROM once GROUP BY 1, 2
), qc AS (
  SELECT query_id, {_stem("term")} AS term, count(*) AS qtf FROM once WHERE term NOT IN ({_in(STOP_WORDS)}) GROUP BY 1, 2
)"""


_ALL = _asked("SELECT query_id, q, k FROM search_queries")

_CANDIDATES = f"""matched AS (
  SELECT c.query_id, p.doc_id, sum(c.qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + {_S.bm25_k1} * (1 - {_S.bm25_b} + {_S.bm25_b} * dl / avg_dl))) AS bm25
  FROM qc c JOIN postings p USING (term) JOIN term_table USING (term) JOIN doc_stats USING (doc_id) CROSS JOIN corpus GROUP BY 1, 2
), cands AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS cand_rank FROM matched) WHERE cand_rank <= {_S.top_candidates}
)"""

_GRID = f"""grid AS (
  SELECT c.query_id, c.doc_id, c.cand_rank, q.term, q.qtf, coalesce(p.tf, 0) AS tf, d.dl, coalesce(t.p_wc, 0) AS p_wc,
    CASE WHEN coalesce(d.dl, 0) = 0 THEN 0.0 ELSE (coalesce(p.tf, 0) + {_S.mu} * coalesce(t.p_wc, 0)) / (d.dl + {_S.mu}) END AS p
  FROM cands c JOIN qt q USING (query_id) LEFT JOIN postings p ON p.doc_id = c.doc_id AND p.term = q.term LEFT JOIN doc_stats d ON d.doc_id = c.doc_id LEFT JOIN term_table t ON t.term = q.term
), lm AS (
  SELECT query_id, doc_id, cand_rank, CASE WHEN min(p) <= 0 THEN -1e9 ELSE sum(CASE WHEN p > 0 THEN qtf * ln(CASE WHEN p > 0 THEN p END) END) END AS log_score FROM grid GROUP BY 1, 2, 3
), span AS (
  SELECT *, min(log_score) OVER (PARTITION BY query_id) AS lo, max(log_score) OVER (PARTITION BY query_id) AS hi FROM lm
), ranked AS (
  SELECT query_id, doc_id, cand_rank, log_score, 100 * (log_score - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(log_score, 9) DESC, cand_rank) AS rank FROM span
)"""

_SEARCH = f"WITH {INDEX}, {_ALL}, {_CANDIDATES}, {_GRID}"
_FIND = f"{_SEARCH}, found AS (SELECT r.query_id, r.rank, r.doc_id AS id, d.url, d.title, d.source, r.score, d.content FROM ranked r JOIN queries q USING (query_id) JOIN docs d ON d.doc_id = r.doc_id WHERE r.rank <= q.k)"


def _one(q: str) -> str:
    one = f"SELECT 1 AS query_id, '{q}' AS q, 10 AS k"
    return f"WITH {INDEX}, {_asked(one)}, {_CANDIDATES}, {_GRID}"


def _knn(distance: str, where: str = "true", out: str = "") -> str:
    d = {
        "l2": "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))",
        "cosine": "1 - list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))))",
    }[distance]
    ranked = f"""SELECT q.vec_id AS query_id, v.vec_id AS id, {d} AS distance FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0 AND {where}"""
    cols = out or "query_id, rank, id, round(distance, 6) AS distance"
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS rank FROM ({ranked})) WHERE rank <= 10"


_HEX = " + ".join(f"{16 ** (3 - i)} * (instr('0123456789abcdef', substr(md5(w), {i + 1}, 1)) - 1)" for i in range(4))


def _embedded(rows: str, key: str, text: str) -> str:
    """(key, v): signed hashed word counts of ``rows``, of unit length, as the engine's stand-in for a model makes them."""
    return f"""SELECT {key}, list_transform(counts, lambda x: (CASE WHEN norm > 0 THEN x / norm ELSE x END)::FLOAT)::DOUBLE[] AS v FROM (
      SELECT {key}, counts, sqrt(list_sum(list_transform(counts, lambda x: x * x))) AS norm FROM (
        SELECT {key}, list_transform(range(64), lambda i: coalesce(list_sum(list_transform(list_filter(hs, lambda h: h % 64 = i), lambda h: CASE WHEN h // 64 % 2 = 1 THEN 1.0 ELSE -1.0 END)), 0.0)) AS counts FROM (
          SELECT {key}, list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda w: {_HEX}) AS hs FROM ({rows}) WHERE {text} IS NOT NULL)))"""


_NEAR = f"""stored AS (SELECT DISTINCT id, content, metadata.doc_id AS doc_id, metadata.title AS title, metadata.source AS source, metadata.publication_date AS date FROM chunks
), chunk_vectors AS ({_embedded("SELECT id, content FROM stored", "id", "content")}
), query_vectors AS ({_embedded("SELECT query_id, q FROM search_queries", "query_id", "q")}
), distances AS (
  SELECT query_id, id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM query_vectors a CROSS JOIN chunk_vectors b
), near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS rank FROM distances) WHERE rank <= {_S.top_candidates}
)"""


def _fused(by_doc: bool) -> str:
    right = "SELECT query_id, id, rank FROM near"
    if by_doc:
        right = "SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), doc_id) AS rank FROM near JOIN stored USING (id) GROUP BY query_id, doc_id"
    return f"""{_SEARCH}, {_NEAR}, right_leg AS ({right}), legs AS (
  SELECT query_id, doc_id AS id, rank, 0 AS leg FROM ranked UNION ALL SELECT query_id, id, rank, 1 AS leg FROM right_leg
), fused AS (
  SELECT query_id, id, sum(1.0 / ({_S.rrf_k} + rank)) AS rrf, min(leg) AS leg, arg_min(rank, leg) AS first FROM legs GROUP BY 1, 2
), fused_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, leg, first, id) AS rank FROM fused)"""


_RRF = "SELECT query_id, rank, id, round(rrf, 9) AS rrf_score FROM fused_ranked WHERE rank <= 10"
_SNIP = "CASE WHEN length({c}) > 200 THEN left({c}, 200) || '...' ELSE {c} END"

_DELTAS = f"""arrived AS (
  SELECT url AS doc_id, coalesce(content, '') AS content, 1 AS gen FROM search_documents WHERE row_id % 2 = 0 AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1
  UNION ALL
  SELECT doc_id, content, 2 FROM (SELECT CASE WHEN row_id % 3 = 0 THEN url ELSE 'd' || (row_id % 100) END AS doc_id, coalesce(content, '') AS content, row_id FROM search_documents WHERE row_id % 2 = 1) WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY row_id DESC) = 1
), left_docs AS (
  SELECT doc_id, arg_max(content, gen) AS content FROM arrived WHERE doc_id NOT IN (SELECT link FROM feed_items WHERE link IS NOT NULL) GROUP BY 1
), left_words AS (SELECT doc_id, unnest({_words("content")}) AS w FROM left_docs
), left_terms AS (SELECT doc_id, {_stem("w")} AS term FROM left_words WHERE w NOT IN ({_in(STOP_WORDS)}))"""

# sentences of a text, an abbreviation's full stop ending none
_B = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"


def _sentences(text: str) -> str:
    marked = rf"regexp_replace({text}, '([.!?…]){_B}+', '\1' || chr(1), 'g')"
    return rf"""parts AS (
      SELECT url, i, regexp_replace(p, '^{_B}+|{_B}+$', '', 'g') AS p FROM (SELECT url, unnest(string_split({marked}, chr(1))) AS p, unnest(range(1, len(string_split({marked}, chr(1))) + 1)) AS i FROM docs)
    ), kept AS (SELECT url, i, p, lag(p) OVER (PARTITION BY url ORDER BY i) AS before FROM parts WHERE p <> ''
    ), numbered AS (SELECT url, i, p, sum(CASE WHEN before IS NOT NULL AND lower(regexp_extract(before, '[^\s]+$')) IN ({_in(sorted(ABBREVIATIONS))}) THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY i) AS s FROM kept
    ), sentences AS (SELECT url, s, string_agg(p, ' ' ORDER BY i) AS sentence FROM numbered GROUP BY 1, 2)"""


_TOKENS = rf"len(regexp_extract_all(sentence, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_B[1:-1]}]'))"
_CHUNKS = rf"""WITH RECURSIVE {DOCS}, {_sentences("title || chr(10) || chr(10) || content")}, counted AS (
  SELECT url, s, {_TOKENS} AS n FROM sentences
), pieces AS (
  SELECT url, s, 0 AS w, n + {SPECIAL_TOKENS} AS n FROM counted WHERE n + {SPECIAL_TOKENS} <= {_S.max_tokens}
  UNION ALL SELECT url, s, w, least({_S.max_tokens - SPECIAL_TOKENS}, n - w * {_S.max_tokens - SPECIAL_TOKENS}) + {SPECIAL_TOKENS} FROM (SELECT url, s, n, unnest(range(0, (n + {_S.max_tokens - SPECIAL_TOKENS - 1}) // {_S.max_tokens - SPECIAL_TOKENS})) AS w FROM counted WHERE n + {SPECIAL_TOKENS} > {_S.max_tokens})
), units AS (
  SELECT url, row_number() OVER (PARTITION BY url ORDER BY s, w) - 1 AS i, n, sum(n) OVER (PARTITION BY url ORDER BY s, w) AS upto FROM pieces
), backs AS (
  SELECT a.url, a.i, a.n, a.upto - a.n AS before, coalesce(min(b.i), a.i) AS back FROM units a LEFT JOIN units b ON b.url = a.url AND b.i < a.i AND a.upto - a.n - (b.upto - b.n) <= {_S.overlap_tokens} GROUP BY 1, 2, 3, 4
), starts AS (SELECT url, i, upto - n AS at FROM units
), packing AS (
  SELECT url, 0::BIGINT AS i, 0::BIGINT AS start, 0::HUGEINT AS total, NULL::HUGEINT AS done FROM units WHERE i = 0
  UNION ALL
  SELECT p.url, p.i + 1, CASE WHEN p.i > p.start AND p.total + u.n > {_S.max_tokens} THEN greatest(p.start, u.back) ELSE p.start END,
    (CASE WHEN p.i > p.start AND p.total + u.n > {_S.max_tokens} THEN u.before - st.at ELSE p.total END + u.n)::HUGEINT,
    CASE WHEN p.i > p.start AND p.total + u.n > {_S.max_tokens} THEN p.total END
  FROM packing p JOIN backs u ON u.url = p.url AND u.i = p.i JOIN starts st ON st.url = p.url AND st.i = greatest(p.start, u.back)
), closed AS (
  SELECT url, i, done AS tokens FROM packing WHERE done IS NOT NULL
  UNION ALL SELECT url, i + 1, total FROM packing QUALIFY row_number() OVER (PARTITION BY url ORDER BY i DESC) = 1
), chunked AS (SELECT url, row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS chunk_number, tokens::BIGINT AS estimated_tokens FROM closed)"""

_INSUFFICIENT = f"""{_FIND}, judged AS (
  SELECT q.query_id, count(f.id) AS n, avg(f.score) AS a FROM queries q LEFT JOIN found f USING (query_id) GROUP BY 1
), scored AS (
  SELECT query_id, n, a, CASE WHEN n = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 0.6 * CASE WHEN n < {_S.min_results} THEN ({_S.min_results} - n) / {_S.min_results}.0 ELSE 0.0 END
    + 0.4 * CASE WHEN a < {_S.min_score} THEN least(1.0, ({_S.min_score} - a) / 100) ELSE 0.0 END)) END AS s FROM judged
)"""

NETLOC = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
_BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}\x{1c}-\x{1f}]"
TRIM = rf"^{_BLANK}+|{_BLANK}+$"

_BY_DATE = "published DESC NULLS LAST, link NULLS LAST, title NULLS LAST, summary NULLS LAST, source NULLS LAST"
_WEB = f"""item_words AS (
  SELECT title, link, published, summary, source, unnest(list_distinct({_words("title")})) AS w FROM (SELECT DISTINCT * FROM feed_items)
), asked_words AS (
  SELECT DISTINCT query_id, w FROM query_words WHERE length(w) > 3
), feed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, {_BY_DATE}) AS pos FROM (
    SELECT query_id, title, link, published, summary, source, max(n) AS n FROM (
      SELECT query_id, title, link, published, summary, source, count(*) AS n FROM item_words JOIN asked_words USING (w) GROUP BY ALL
      UNION ALL SELECT query_id, title, link, published, summary, source, 0 FROM (SELECT DISTINCT query_id FROM queries), (SELECT DISTINCT * FROM feed_items ORDER BY {_BY_DATE} LIMIT {2 * _S.web_results_limit})
    ) GROUP BY 1, 2, 3, 4, 5, 6)
), web AS (
  SELECT query_id, link AS url, min(pos) AS pos FROM feed JOIN scored USING (query_id) WHERE pos <= {_S.web_results_limit} AND s > {_S.insufficiency_threshold} AND link IS NOT NULL AND link <> '' GROUP BY 1, 2
)"""

ORACLES: dict[str, str] = {
    "token_counts": f"WITH {INDEX} SELECT doc_id, term, tf FROM postings",
    "doc_lengths": f"WITH {INDEX} SELECT doc_id, dl FROM doc_stats",
    "term_collection_stats": f"WITH {INDEX} SELECT term, cf::BIGINT AS cf, df, round(p_wc, 12) AS p_wc FROM term_table",
    "model_stats": f"WITH {INDEX} SELECT n_docs, (SELECT count(*) FROM term_table) AS n_terms, total_tokens::BIGINT AS total_tokens, round(avg_dl, 6) AS avg_dl, {_S.mu}::DOUBLE AS mu FROM corpus",
    "term_stats": f"WITH {INDEX}, {_ALL} SELECT term, coalesce(cf, 0)::BIGINT AS cf, coalesce(df, 0) AS df, round(coalesce(p_wc, 0), 12) AS p_wc, n_docs FROM (SELECT DISTINCT term FROM qt) LEFT JOIN term_table USING (term) CROSS JOIN corpus",
    "term_frequency_lookup": f"WITH {INDEX} SELECT d.doc_id, coalesce(p.tf, 0) AS tf FROM docs d LEFT JOIN postings p ON p.doc_id = d.doc_id AND p.term = {_stem(chr(39) + 'acuerdo' + chr(39))}",
    "simple_tokens": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM documents) GROUP BY 1, 2",
    "stemmed_terms": f"SELECT w AS word, {_stem('w')} AS stem FROM (SELECT DISTINCT unnest({_words('text')}) AS w FROM documents)",
    "stop_filtered_tokens": f"SELECT doc_id, len({_words('text')}) AS n_words, len(list_filter({_words('text')}, lambda w: w NOT IN ({_in(STOP_WORDS)}))) AS n_terms FROM documents",
    "candidates_or": f"WITH {INDEX}, {_ALL}, {_CANDIDATES} SELECT query_id, doc_id FROM matched",
    "bm25_top200": f"WITH {INDEX}, {_ALL}, {_CANDIDATES} SELECT query_id, doc_id, round(bm25, 6) AS bm25, cand_rank FROM cands",
    "lmir_topk": f"{_FIND} SELECT query_id, rank, id, title, source, round(score, 4) AS score, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS snippet FROM found",
    "lmir_scores": f"{_SEARCH} SELECT query_id, doc_id, round(log_score, 6) AS log_score, round(score, 4) AS score FROM ranked",
    "lmir_explain": f"{_SEARCH} SELECT query_id, doc_id, dl, {_S.mu}::DOUBLE AS mu, term, tf, round(p_wc, 12) AS p_w_c, round(p, 9) AS p_w_d FROM grid",
    "lmir_oov_query": f"{_one('acuerdo xqzzyw')} SELECT doc_id, round(log_score, 6) AS log_score, round(score, 6) AS score FROM ranked",
    "lmir_duplicate_terms": f"{_one('acuerdo acuerdo energía')} SELECT doc_id, round(log_score, 6) AS log_score FROM ranked",
    "knn_l2": _knn("l2"),
    "knn_cosine": _knn("cosine"),
    "knn_filtered": _knn("l2", "(v.label < 3 OR v.label IN (7, 8))"),
    "dense_results": _knn("l2", out="query_id, rank, id, 'u' || id AS url, 'Título ' || id AS title, (SELECT label::VARCHAR FROM embeddings e WHERE e.vec_id = id) AS source, round(1 - distance / 2, 6) AS score, left(repeat('texto ' || id, 30), 200) || '...' AS snippet"),
    "knn_store": """WITH usable AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM vector_store WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
      ), sized AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM usable
      ), near AS (SELECT q.vec_id AS query_id, x.vec_id AS id, 1 - list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) / (q.n * x.n) AS distance FROM sized q CROSS JOIN sized x WHERE q.vec_id % 50 = 0
      ) SELECT query_id, rank, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS rank FROM near) WHERE rank <= 10""",
    "vector_lifecycle": "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 2 = 0 THEN 'first' ELSE 'again' END AS title, len(embedding) AS n FROM embeddings WHERE vec_id % 7 <> 0",
    "vector_dimensions": "SELECT len(embedding) AS dimensions, count(*) AS n FROM vector_store WHERE embedding IS NOT NULL GROUP BY 1",
    "dense_search": f"WITH {_NEAR} SELECT query_id, rank, id, doc_id AS url, title, source, date, round(1 - distance / 2, 6) AS score, left(content, 200) || '...' AS snippet FROM near JOIN stored USING (id) JOIN search_queries USING (query_id) WHERE rank <= k",
    "hybrid_search": f"""{_fused(False)} SELECT f.query_id, f.rank, f.id, coalesce(d.url, f.id) AS url, coalesce(d.title, c.title) AS title, coalesce(d.source, c.source) AS source, round(r.score, 4) AS score, round(f.rrf, 9) AS rrf_score,
      CASE WHEN d.doc_id IS NOT NULL THEN {_SNIP.format(c="d.content")} ELSE left(c.content, 200) || '...' END AS snippet
      FROM fused_ranked f JOIN queries q USING (query_id) LEFT JOIN ranked r ON r.query_id = f.query_id AND r.doc_id = f.id LEFT JOIN docs d ON d.doc_id = r.doc_id LEFT JOIN stored c ON c.id = f.id WHERE f.rank <= q.k""",
    "api_answers": f"""{_FIND} SELECT q.query_id, q.q AS query, f.rank - 1 AS pos, f.id, f.title, f.url, f.source, CASE WHEN f.id IS NOT NULL THEN '' END AS date, round(f.score, 4) AS score, {_SNIP.format(c="f.content")} AS snippet FROM queries q LEFT JOIN found f USING (query_id)""",
    "index_deltas": f"WITH {_DELTAS} SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df, round(count(*) / (SELECT count(*) FROM left_terms), 12) AS p_wc FROM left_terms GROUP BY 1",
    "index_compacted": f"WITH {_DELTAS} SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM left_terms JOIN (SELECT doc_id, count(*) AS dl FROM left_terms GROUP BY 1) USING (doc_id) GROUP BY 1, 2",
    "chunk_sizes": f"{_CHUNKS} SELECT url || '_' || chunk_number AS id, url AS doc_id, chunk_number, estimated_tokens FROM chunked",
    "chunk_count": f"{_CHUNKS} SELECT count(*) AS n_rows, count(*) AS n_made FROM chunked",
    "rrf_fusion": f"{_fused(False)} {_RRF}",
    "rrf_fuse_doc": f"{_fused(True)} {_RRF}",
    "insufficiency_score": f"{_INSUFFICIENT} SELECT query_id, n AS n_results, round(a, 4) AS avg_score, round(s, 6) AS insufficiency_score, s > {_S.insufficiency_threshold} AS triggered FROM scored",
    "fallback_combine": f"""{_INSUFFICIENT}, {_WEB}, both_legs AS (
      SELECT query_id, rank AS pos, 0 AS leg, 'local' AS origin, url, round(score, 4) AS score FROM found WHERE url <> ''
      UNION ALL SELECT w.query_id, w.pos, 1, 'web', w.url, 0.0 FROM web w WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = w.query_id AND f.url = w.url)
    ) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY leg, pos) AS position, origin, url, score FROM both_legs""",
    "web_store": f"{_INSUFFICIENT}, {_WEB} SELECT doc_id, url FROM docs UNION SELECT 'web_' || left(sha256(url), 16), url FROM web",
    "web_short_ids": "SELECT 'web_' || left(sha256(link), 16) AS doc_id, link AS url, title, source FROM feed_items",
    "feed_results": "SELECT link AS url, title, source, 0.0::DOUBLE AS score, left(summary, 200) AS snippet FROM feed_items",
    "key_terms": f"SELECT query_id, array_to_string(list_filter(string_split_regex(regexp_replace(lower(q), '{TRIM}', '', 'g'), '{_BLANK}+'), lambda w: length(w) > 3 AND w NOT IN ({_in(KEY_TERM_STOP)})), '|') AS terms FROM search_queries",
    "query_variants": " UNION ALL ".join(f"SELECT query_id, {i}::BIGINT AS pos, q || ' {e}' AS variant FROM search_queries" for i, e in enumerate(VARIANT_ENDINGS)),
    "upsert_latest": f"WITH {DOCS} SELECT url, row_id, title, length(content) AS n, len(authors) AS n_authors FROM docs",
    "delete_by_id": f"WITH {DOCS} SELECT url, row_id FROM docs WHERE NOT EXISTS (SELECT 1 FROM feed_items f WHERE f.link = docs.url)",
    "prefix_limit": f"WITH {DOCS} SELECT url, title FROM docs ORDER BY url LIMIT 10",
    "keyset_page": f"WITH {DOCS} SELECT doc_id, title, content, source FROM docs ORDER BY doc_id",
    "snippets": f"WITH {DOCS} SELECT url, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS snippet, left(content, 200) || '...' AS snippet_always FROM docs",
    "clean_text_rules": rf"""SELECT doc_id, coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{{00}}-\x{{08}}\x{{0b}}-\x{{1f}}\x{{7f}}-\x{{9f}}]', '', 'g'),
      '[\t ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '{TRIM}', '', 'g'), '') AS text FROM documents""",
    "source_names": f"WITH {DOCS} SELECT url, replace({NETLOC.format(u='url')}, 'www.', '') AS name FROM docs",
    "url_filter": f"""SELECT link, coalesce(lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) IN ('http', 'https')
      AND len(list_filter(['malvenda.example', 'torrubel.example', 'corval.example'], lambda d: contains({NETLOC.format(u="link")}, d))) > 0
      AND NOT regexp_matches(lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)), '\\.(pdf|jpg|jpeg|png|gif|zip|rar|mp4|mp3|css|js)$'), false) AS valid FROM (SELECT DISTINCT link FROM feed_items)""",
    "scraper_dispatch": f"WITH {DOCS} SELECT CASE lower({NETLOC.format(u='url')}) WHEN 'www.malvenda.example' THEN 'rt' WHEN 'www.torrubel.example' THEN 'bbc' ELSE 'base' END AS site, count(*) AS n FROM docs GROUP BY 1",
    "article_min_length": f"WITH {DOCS} SELECT url FROM docs WHERE length(regexp_replace(content, '{TRIM}', '', 'g')) >= {_S.min_article_chars}",
    "link_dedupe": f"WITH {DOCS} SELECT link, count(*) AS n FROM feed_items WHERE link IS NOT NULL AND NOT EXISTS (SELECT 1 FROM docs WHERE docs.url = feed_items.link) GROUP BY 1",
    "sentence_units": rf"""WITH {DOCS}, {_sentences("content")} SELECT url, count(s) AS n_sentences FROM docs LEFT JOIN sentences USING (url) GROUP BY 1""",
    "api_standardized": "SELECT coalesce(nullif(CASE WHEN length(title) % 2 = 0 THEN title ELSE '' END, ''), link) AS id, 'Sin título' AS title, link AS url, source, '' AS date, 0.0::DOUBLE AS score, '' AS snippet FROM feed_items",
    "iso_dates": r"""SELECT row_id, us FROM (SELECT row_id, epoch_us(TRY_CAST(CASE WHEN regexp_matches(date, '(Z|[+-]\d\d:\d\d)$') THEN date ELSE date || 'Z' END AS TIMESTAMPTZ)) AS us
      FROM search_documents WHERE regexp_matches(date, '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:\d\d)?$')) WHERE us IS NOT NULL""",
}
