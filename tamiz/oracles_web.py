"""SQL twins of the acquisition queries."""

from __future__ import annotations

from .queries_web import HOSTS, KEPT, MAX_PAGES


def site_articles(docs: str, trim: str, least: int) -> str:
    hosts = ", ".join(f"'{h}'" for h in HOSTS)
    tidy = lambda t: rf"trim(regexp_replace(regexp_replace({t}, '{KEPT.replace(chr(39), chr(39) * 2)}', ' ', 'g'), ' +', ' ', 'g'))"
    text = "array_to_string(l, chr(10) || chr(10))"
    return rf"""WITH {docs}, raw AS (
      SELECT d.row_id, d.title, s.content, s.fetched_at FROM docs d JOIN search_documents s USING (row_id)
    ), lined AS (
      SELECT row_id, {tidy("coalesce(title, '')")} AS title, fetched_at, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: {tidy('x')}), lambda x: x <> '') AS l FROM raw
    ), bodies AS (
      SELECT row_id, title, fetched_at, CASE row_id % 8
        WHEN 0 THEN array_to_string(list_append(l, 'Por Ana Paz Luis Gil'), chr(10) || chr(10))
        WHEN 1 THEN regexp_replace({text}, '\[[^\n]*?\]', '', 'g')
        WHEN 2 THEN array_to_string(list_append(l, 'Fin'), chr(10) || chr(10))
        WHEN 3 THEN array_to_string(list_append(l, 'Cierre'), chr(10) || chr(10))
        WHEN 4 THEN regexp_replace({text}, 'Foto:[^\n]*', '', 'g')
        WHEN 6 THEN array_to_string(list_append(l, 'uno'), chr(10) || chr(10))
        ELSE {text} END AS body FROM lined WHERE row_id % 5 <> 0
    ), cleaned AS (
      SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, ' +', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '{trim}', '', 'g') AS content FROM bodies
    ) SELECT 'https://' || CASE WHEN row_id % 2 = 0 THEN 'www.' ELSE '' END || ([{hosts}])[row_id % 8 + 1] || '/n' || row_id AS url, ([{hosts}])[row_id % 8 + 1] AS source, title, content,
      CASE row_id % 8 WHEN 2 THEN 'Ana Paz' WHEN 3 THEN 'Luis Gil' WHEN 5 THEN 'Ana Paz|Luis Gil|Eva Mar' WHEN 6 THEN 'Eva Mar|Ana Paz' WHEN 7 THEN 'Eva Mar' ELSE 'Ana Paz|Luis Gil' END AS authors,
      epoch_us(date_trunc('second', fetched_at)) AS us FROM cleaned WHERE length(content) >= {least}"""


_LINKS = """edges AS (
  SELECT 'https://bbc.com/p' || row_id AS src, unnest(['https://bbc.com/p' || row_id * 2, 'https://bbc.com/p' || row_id * 3, 'https://bbc.com/p' || row_id + 1, 'https://bbc.com/f.PDF', 'https://corval.example/z']) AS dst,
    unnest([0, 1, 2, 3, 5]) AS anchor FROM search_documents WHERE row_id % 7 <> 0
), links AS (SELECT src, dst, min(anchor) AS pos FROM edges GROUP BY 1, 2)"""


def _crawl(limit: int | None) -> str:
    steps = [
        "f0 AS (SELECT * FROM (VALUES ('https://bbc.com/p3', [0]), ('https://bbc.com/p1', [1]), ('https://bbc.com/p7', [2]), ('https://bbc.com/p5', [3])) AS t(url, place))",
        "pages AS (SELECT 'https://bbc.com/p' || row_id AS url FROM search_documents WHERE row_id % 7 <> 0)",
    ]
    for d in range(4):
        done = " + ".join(f"(SELECT count(*) FROM g{e})" for e in range(d)) or "0"
        cap = f" QUALIFY row_number() OVER (ORDER BY place, url) <= {limit} - ({done})" if limit else ""
        steps.append(f"g{d} AS (SELECT url, place FROM f{d} WHERE url IN (SELECT url FROM pages) AND NOT url LIKE 'https://bbc.com/p4%'{cap})")
        seen = " UNION ALL ".join(f"SELECT url FROM g{e} UNION ALL SELECT url FROM f{e} WHERE url LIKE 'https://bbc.com/p4%'" for e in range(d + 1))
        steps.append(f"f{d + 1} AS (SELECT dst AS url, min(list_append(place, pos)) AS place FROM g{d} JOIN links ON src = url WHERE dst LIKE 'https://bbc.com/%' AND NOT lower(dst) LIKE '%.pdf' AND dst NOT IN ({seen}) GROUP BY 1)")
    return f"WITH {_LINKS}, " + ", ".join(steps[:-1]) + ", got AS (" + " UNION ALL ".join(f"SELECT url, {d}::BIGINT AS depth, place FROM g{d}" for d in range(4)) + ")"


def oracles(docs: str, netloc: str, trim: str, least: int) -> dict[str, str]:
    host = netloc.format(u="link")
    return {
        "site_articles": site_articles(docs, trim, least),
        "feed_links": """WITH quoted AS (SELECT 'https://lector.example/' || length(link) AS src, link, title FROM feed_items WHERE NOT regexp_matches(link, '[&''"<>]'))
          SELECT src, link AS dst FROM quoted WHERE link LIKE 'http%' UNION SELECT src, 'https://lector.example/de/' || length(title) FROM quoted WHERE title IS NOT NULL""",
        "crawl_fifo": f"{_crawl(MAX_PAGES)} SELECT url, depth, array_to_string(place, '.') AS place FROM got",
        "crawl_whole": f"{_crawl(None)} SELECT url, depth FROM got",
        "robots_rules": f"SELECT DISTINCT link AS url, NOT ({host} = 'www.torrubel.example' OR {host} = 'www.malvenda.example' AND contains(link, 'www.malvenda.example/rss/')) AS allowed FROM feed_items WHERE link IS NOT NULL",
        "frontier_step": f"""WITH {_LINKS}, pages AS (SELECT row_id, 'https://bbc.com/p' || row_id AS url FROM search_documents WHERE row_id % 7 <> 0)
          SELECT DISTINCT dst AS url, 1::BIGINT AS depth FROM links WHERE src IN (SELECT url FROM pages WHERE row_id < 100) AND dst NOT IN (SELECT url FROM pages WHERE row_id < 100 OR row_id % 3 = 0)""",
        "jsonl_documents": "SELECT url, source, coalesce(title, '') AS title, length(content) AS n, array_to_string(list_transform(coalesce(authors, []), lambda a: coalesce(a, '?')), '|') AS authors, epoch_us(date_trunc('second', fetched_at)) AS us FROM search_documents WHERE url IS NOT NULL AND content IS NOT NULL",
        "feed_xml": rf"""SELECT title, link, epoch_us(date_trunc('second', published)) AS us, coalesce(trim(regexp_replace(regexp_replace(summary, '{KEPT.replace(chr(39), chr(39) * 2)}', ' ', 'g'), ' +', ' ', 'g')), '') AS summary, 'RSS' AS source FROM feed_items""",
        "seed_urls": "SELECT trim(link) AS url FROM feed_items WHERE link IS NOT NULL AND coalesce(length(title) % 3 <> 0, true) AND trim(link) <> ''",
        "stream_arrivals": "SELECT epoch_us(date_trunc('hour', fetched_at)) AS hour_us, source, count(*) AS n_docs FROM search_documents WHERE url IS NOT NULL AND content IS NOT NULL AND fetched_at IS NOT NULL GROUP BY 1, 2",
        "stream_documents": """WITH parts AS (SELECT url, row_id % 2 AS part, max_by(content, row_id) AS content FROM search_documents WHERE url IS NOT NULL AND content IS NOT NULL GROUP BY 1, 2)
          SELECT url, length(max_by(content, part)) AS n FROM parts GROUP BY 1""",
    }
