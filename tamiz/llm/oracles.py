"""SQL twins, for DuckDB, of the queries here that SQL can express."""

from __future__ import annotations

_BLANKS = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"

_LINES = rf"""lines AS (
  SELECT row_id, source, url, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no, unnest(string_split(content, chr(10))) AS line FROM search_documents WHERE content IS NOT NULL
), worded AS (
  SELECT row_id, source, url, line_no, regexp_replace(trim(regexp_replace(lower(line), '{_BLANKS}', ' ', 'g')), '\p{{Nd}}+', '0', 'g') AS w FROM lines
), repeated AS (
  SELECT source, w FROM worded WHERE w <> '' GROUP BY 1, 2 HAVING count(DISTINCT url) >= 8
)"""

_CONTENT = """SELECT d.row_id, CASE WHEN d.content IS NULL THEN NULL ELSE coalesce(k.content, '') END AS content FROM search_documents d LEFT JOIN (
      SELECT row_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM lines ANTI JOIN flagged USING (row_id, line_no) GROUP BY 1) k USING (row_id)"""

_EVEN = "SELECT source, w FROM worded WHERE w <> '' AND row_id % 2 = 0 GROUP BY 1, 2 HAVING count(DISTINCT url) >= 8"

_SIMILAR = r"""texts AS (
      SELECT row_id, regexp_extract_all(lower(coalesce(title, '') || chr(10) || content), '[\p{L}\p{N}]+') AS ws FROM search_documents WHERE content <> ''
    ), triples AS (
      SELECT DISTINCT row_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t FROM (SELECT row_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM texts WHERE len(ws) > 2)
    ), sizes AS (SELECT row_id, count(*) AS n FROM triples GROUP BY 1
    ), common AS (SELECT a.row_id AS row_a, b.row_id AS row_b, count(*) AS c FROM triples a JOIN triples b USING (t) WHERE a.row_id < b.row_id GROUP BY 1, 2
    ), alike AS (SELECT row_a, row_b FROM common JOIN sizes x ON x.row_id = row_a JOIN sizes y ON y.row_id = row_b WHERE c / (x.n + y.n - c) >= 0.6)"""

_OVER = rf"""SELECT DISTINCT id FROM chunks WHERE len(regexp_extract_all(content, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x{{b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{1c}}-\x{{1f}}]'))
      > (SELECT max_tokens FROM token_limits WHERE limit_name = 'chunk')"""

ORACLES: dict[str, str] = {
    "p3_cleaned": f"WITH {_LINES}, flagged AS (SELECT row_id, line_no FROM worded JOIN repeated USING (source, w)) {_CONTENT}",
    "p3_rebuilt": f"""WITH {_LINES}, flagged AS (SELECT row_id, line_no FROM worded JOIN repeated USING (source, w)), crossed AS (SELECT * FROM repeated EXCEPT {_EVEN}
      ), stale AS (SELECT row_id FROM worded JOIN repeated USING (source, w) WHERE row_id % 2 = 1 UNION SELECT row_id FROM worded JOIN crossed USING (source, w) WHERE row_id % 2 = 0)
      SELECT row_id, content FROM ({_CONTENT}) SEMI JOIN stale USING (row_id)""",
    "p3_found": f"WITH {_LINES} SELECT row_id, line_no FROM worded JOIN repeated USING (source, w)",
    "p4_found": f"WITH {_SIMILAR} SELECT row_a, row_b FROM alike",
    "p4_groups": f"""WITH RECURSIVE {_SIMILAR}, ends AS (SELECT row_a AS a, row_b AS b FROM alike UNION ALL SELECT row_b, row_a FROM alike
    ), same AS (SELECT row_id, min(row_id) OVER (PARTITION BY coalesce(title, '') || chr(10) || content) AS text_id FROM search_documents WHERE content <> ''
    ), hops AS (SELECT row_id AS a, text_id AS b FROM same UNION SELECT text_id, row_id FROM same UNION SELECT a, b FROM ends
    ), reach AS (SELECT a, b FROM hops UNION SELECT r.a, h.b FROM reach r JOIN hops h ON h.a = r.b
    ), degree AS (SELECT a AS row_id, count(DISTINCT y.text_id) AS n FROM ends JOIN same x ON x.row_id = a JOIN same y ON y.row_id = b WHERE x.text_id <> y.text_id GROUP BY 1)
    SELECT row_id, min(b) AS group_id, coalesce(any_value(n), 0) AS n_links FROM same JOIN reach ON a = row_id LEFT JOIN degree USING (row_id) GROUP BY 1""",
    "p5_recall": """SELECT count(*) AS n_queries, true AS holds FROM vector_store WHERE vec_id % 50 = 0 AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "p6_found": _OVER,
    "p6_checks": f"SELECT id, true AS tiles, true AS fits, true AS overlaps FROM ({_OVER})",
    "p7_checks": f"WITH {_LINES} SELECT row_id, count(*) FILTER (WHERE w <> '') AS n_lines FROM worded GROUP BY 1",
    "p8_checks": "SELECT count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_cut, 0::BIGINT AS n_over, true AS near_bound FROM documents",
    "p9_checks": "SELECT source, true AS cap_kept, true AS share_met FROM mix_targets",
}
