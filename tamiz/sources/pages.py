"""Articles out of fetched pages: one HTML pass in Python, the site rules as data, the rest as columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.dates import parse_iso

# The class of site rules for each host, with and without "www.".
SITES = {
    prefix + host: site
    for host, site in [
        ("cubadebate.cu", "cubadebate"), ("telemundo.com", "telemundo"), ("bbc.com", "bbc"), ("actualidad.rt.com", "rt"),
        ("presidencia.gob.cu", "presidencia"), ("telesurtv.net", "telesur"), ("lanacion.com.ar", "lanacion"),
    ]
    for prefix in ("", "www.")
}

# Where a site keeps its text: the container (words of its class), the blocks in it (tag, tag.class, or
# class>tag for the children of such an element), the class of parts left out.
RULES = {
    "bbc": ("", "css-1k9op6x+e17x9cvu0>p css-1k9op6x+e17x9cvu0>h2", ""),
    "rt": ("ArticleView-text", "Text-root>p h2 h3 li blockquote", "EmbedBlock-twitter"),
    "lanacion": ("", "p.com-paragraph li.com-item h3.step-title h2 blockquote", ""),
    "telemundo": ("article-body__content", "p.body-graf li h2 blockquote h3.body-heading", "article-faq-embed"),
    "base": ("article", "p h2 h3 li", ""),
}
BBC_NOTICE = "Y recuerda que puedes recibir notificaciones en nuestra app. Descarga la última versión y actívalas."
ARTICLE_TYPES = ("Article", "NewsArticle")
NEWS_SCHEMA = "Schema_NewsArticle"
AUTHOR_CLASS = "content-area__text__full__fuente__detalle"

# sites that have no text where their own blocks are missing; the others fall back to the page's paragraphs
OWN_BLOCKS_ONLY = ("bbc", "lanacion")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "noscript", "template"))

PARSED = (
    "url STRING, has_og_type BOOLEAN, metas MAP<STRING, STRING>, own_date STRING, own_authors ARRAY<STRING>, any_date STRING, any_authors ARRAY<STRING>, "
    "page_title STRING, heading STRING, picked ARRAY<STRING>, plain ARRAY<STRING>, signed STRING, bylines ARRAY<STRING>"
)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.metas: dict[str, str] = {}
        self.has_og_type = False
        self.jsonld: list[tuple[str, str]] = []  # id and text
        self.stack: list[tuple[str, str]] = []
        self.blocks: list[dict] = []
        self.open: list[dict] = []
        self.title: list[str] = []
        self.script: list[str] | None = None
        self.script_id = ""
        self.strong: list[str] | None = None
        self.after_por = False
        self.bylines: list[str] = []
        self.anchor: list[str] | None = None
        self.by_done = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("property") or a.get("name")
            if name == "og:type":
                self.has_og_type = True
            if name and name not in self.metas and "content" in a:
                self.metas[name] = a["content"]
        if tag in _VOID:
            return
        if tag in ("p", "li"):  # their ends may be missing
            self._close(tag)
        self.stack.append((tag, f"{tag} {a.get('class', '')} {a.get('id', '')} {a.get('data-testid', '')}"))
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.script, self.script_id = [], a.get("id", "")
        if tag in ("p", "h1", "h2", "h3", "li", "blockquote"):
            block = {"tag": tag, "path": [x for _, x in self.stack], "has_link": False, "parts": []}
            self.blocks.append(block)
            self.open.append(block)
        if tag == "a":
            for block in self.open:
                block["has_link"] = True
            self.anchor = []
        if tag == "strong":
            self.strong = []

    def _close(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack:
                top, _ = self.stack[-1]
                if tag in ("p", "li") and top in ("div", "ul", "ol", "section", "article", "body", "main"):
                    return
                self.stack.pop()
                if self.open and self.open[-1]["tag"] == top:
                    self.open.pop()
                if top == tag:
                    return

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self.jsonld.append((self.script_id, "".join(self.script)))
            self.script = None
        if tag == "a" and self.anchor is not None:
            if self.after_por and not self.by_done:
                self.bylines.append("".join(self.anchor).strip())
            self.anchor = None
        if tag == "strong" and self.strong is not None:
            if "Por" in "".join(self.strong) and not self.bylines:
                self.after_por = True
            self.strong = None
        if tag in ("p", "div") and self.after_por:
            self.by_done, self.after_por = True, False
        self._close(tag)

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
            return
        if any(t in _HIDDEN for t, _ in self.stack):
            return
        if any(t == "title" for t, _ in self.stack):
            self.title.append(data)
        if self.strong is not None:
            self.strong.append(data)
        if self.anchor is not None:
            self.anchor.append(data)
        for block in self.open:
            block["parts"].append(data)


def _names(author) -> list[str]:
    """Names of a JSON-LD author, which is one object or a list of them."""
    found = author if isinstance(author, list) else [author]
    return [a["name"] for a in found if isinstance(a, dict) and isinstance(a.get("name"), str) and a["name"]]


def _unique(names: list[str]) -> list[str]:
    return list(dict.fromkeys(n.strip() for n in names if n.strip()))


def _takes(site: str, block: dict) -> bool:
    """Whether the site's rule takes a text block."""
    container, wanted, dropped = RULES[site]
    own, above = block["path"][-1], block["path"][-2] if len(block["path"]) > 1 else ""
    if container and not any(container in x for x in block["path"]) or dropped and any(dropped in x for x in block["path"]):
        return False
    if site == "bbc" and (block["tag"] == "p" and block["has_link"] or block["text"] == BBC_NOTICE):
        return False
    for spec in wanted.split():
        parent, _, rest = spec.rpartition(">")
        tag, _, name = rest.partition(".")
        if block["tag"] == tag and name in own and all(part in above for part in parent.split("+")):
            return True
    return False


def site_metadata(site: str, scripts: list[tuple[str, str]]) -> tuple[str | None, list[str] | None]:
    """(date text, authors) that the site's own rule takes from its JSON-LD scripts (id, text); None where it has none.

    "bbc": the first script's first node; "rt": scripts of an article's type; "lanacion": the script with the news
    schema's id; "telesur": the authors of every script; "telemundo": the first date. Malformed scripts are skipped.
    """
    read = []
    for name, text in scripts:
        try:
            read.append((name, json.loads(text)))
        except ValueError:
            read.append((name, None))
    dates = [d["datePublished"] for _, d in read if isinstance(d, dict) and isinstance(d.get("datePublished"), str)]
    if site == "bbc":
        graph = read[0][1].get("@graph") if read and isinstance(read[0][1], dict) else None
        node = graph[0] if isinstance(graph, list) and graph and isinstance(graph[0], dict) else {}
        date = node.get("datePublished")
        return date if isinstance(date, str) else None, _names(node.get("author"))
    if site == "rt":
        nodes = [d for _, d in read if isinstance(d, dict) and d.get("@type") in ARTICLE_TYPES]
        date = next((n["datePublished"] for n in nodes if isinstance(n.get("datePublished"), str) and n["datePublished"]), None)
        return date, next((_names(n["author"]) for n in nodes if isinstance(n.get("author"), (dict, list))), None)
    if site == "lanacion":
        node = next((d for name, d in read if name == NEWS_SCHEMA), None)
        node = node if isinstance(node, dict) else {}
        date = node.get("datePublished")
        return date if isinstance(date, str) and date else None, _unique(_names(node.get("author"))) or None
    if site == "telesur":
        entries = [e for _, d in read for e in (d if isinstance(d, list) else [d]) if isinstance(e, dict)]
        return None, _unique([n for e in entries for n in _names(e.get("author"))]) or None
    if site == "telemundo":
        return next(iter(dates), None), None
    return None, None


def any_metadata(scripts: list[tuple[str, str]]) -> tuple[str | None, list[str]]:
    """First date and all authors of any JSON-LD node: a stand-in for a general article reader."""
    nodes = _article_nodes([text for _, text in scripts])
    date = next((n["datePublished"] for n in nodes if isinstance(n.get("datePublished"), str)), None)
    return date, _unique([n for node in nodes for n in ([node["author"]] if isinstance(node.get("author"), str) else _names(node.get("author")))])


def parse_pages(pages: DataFrame, sites: dict[str, str] = SITES) -> DataFrame:
    """One row a page of ``pages`` (url, html): its metas, what its JSON-LD says, its title, and its text blocks in document order, those
    that the site's rule takes and all paragraphs and subheads.
    A page that cannot be read, or NULL, gives a row without content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, html in zip(batch["url"], batch["html"], strict=True):
                reader = _Reader()
                try:
                    reader.feed(html or "")
                    reader.close()
                except Exception:
                    reader = _Reader()
                text = lambda parts: " ".join(" ".join(parts).split())
                blocks = [b | {"text": text(b["parts"])} for b in reader.blocks]
                heading = next((b["text"] for b in blocks if b["tag"] == "h1"), None)
                blocks = [b for b in blocks if b["text"]]
                host = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", url or "")
                site = sites.get(host[1].lower() if host else "", "base")
                rule = site if site in RULES else "base"
                picked = [b["text"] for b in blocks if _takes(rule, b)]
                plain = [b["text"] for b in blocks if b["tag"] in ("p", "h2", "h3")]
                signed = next((b["text"] for b in blocks if b["tag"] == "p" and AUTHOR_CLASS in b["path"][-1] and b["text"].startswith("Autor:")), None)
                title = "".join(reader.title).strip() or None
                rows.append((url, reader.has_og_type, reader.metas, *site_metadata(site, reader.jsonld), *any_metadata(reader.jsonld), title, heading, picked, plain, signed, reader.bylines))
            yield pd.DataFrame(rows, columns=["url", "has_og_type", "metas", "own_date", "own_authors", "any_date", "any_authors", "page_title", "heading", "picked", "plain", "signed", "bylines"])

    return pages.select("url", "html").mapInPandas(run, PARSED)


def _article_nodes(texts) -> list[dict]:
    nodes = []
    for t in texts:
        try:
            found = json.loads(t)
        except ValueError:
            continue
        todo = [found]
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                nodes.append(x)
                todo = list(x.get("@graph") or []) + todo
    return nodes


def scraper_of(url, sites: dict[str, str] = SITES):
    """The class of site rules of a url's host, "base" for any other."""
    pairs = [F.lit(x) for pair in sites.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(T.netloc(url))), F.lit("base"))


def long_enough(content, least: int):
    """An article has so many characters between its outer blanks; NULL has none."""
    return F.coalesce(F.length(T.strip(content)) >= least, F.lit(False))


def extract_articles(pages: DataFrame, settings: Settings = Settings(), sites: dict[str, str] = SITES) -> DataFrame:
    """Articles (source, url, title, content, authors, date) of ``pages`` (url, html).

    Left out: pages whose og:type is there and is not "article" (also one without a value), and pages of
    fewer than ``min_article_chars`` characters of text. A bad date is NULL and loses no page.
    """
    parsed = parse_pages(pages, sites).withColumn("site", scraper_of(F.col("url"), sites))
    kind = F.try_element_at(F.col("metas"), F.lit("og:type"))
    parsed = parsed.where(~F.col("has_og_type") | (F.coalesce(kind, F.lit("")) == "article"))
    site, meta = F.col("site"), lambda name: F.nullif(F.try_element_at(F.col("metas"), F.lit(name)), F.lit(""))

    def by_site(rules: dict, other):
        found = None
        for name, value in rules.items():
            found = F.when(site == name, value) if found is None else found.when(site == name, value)
        return found.otherwise(other)

    parsed = parsed.withColumn("paragraphs", F.when((F.size("picked") > 0) | site.isin(*OWN_BLOCKS_ONLY), F.col("picked")).otherwise(F.col("plain")))
    paragraphs = F.col("paragraphs")
    body = T.join_paragraphs(F.when(site == "rt", T.drop_last_pointer(paragraphs)).otherwise(paragraphs))
    body = by_site({"presidencia": T.drop_photo_credits(body), "telesur": T.cut_author_tail(body), "telemundo": T.drop_bracketed(T.drop_leading_byline(body))}, body)
    parsed = parsed.withColumn("content", T.clean_text(body))
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(F.size(c) > 0, c)
    one_meta = F.when(meta("article:author").isNotNull(), F.array(meta("article:author"))).otherwise(none)
    general = F.coalesce(listed(F.col("any_authors")), F.when(meta("author").isNotNull(), F.array(meta("author"))), none)
    own = F.col("own_authors")
    authors = by_site(
        {
            "bbc": own, "rt": F.coalesce(own, one_meta), "lanacion": F.coalesce(listed(own), general), "telesur": F.coalesce(listed(own), T.autor_paragraph(F.col("signed")), none),
            "telemundo": T.byline_authors(T.join_paragraphs(F.col("plain")), general), "presidencia": F.when(meta("article:author").isNotNull(), T.slash_authors(meta("article:author"))).otherwise(none),
            "cubadebate": F.coalesce(listed(general), listed(F.col("bylines")), none),
        },
        F.coalesce(listed(general), listed(F.col("bylines")), listed(T.byline_authors(F.array_join("paragraphs", "\n"), none)), one_meta),
    )
    usual = F.coalesce(parse_iso(meta("article:published_time")), parse_iso(F.col("any_date")))
    date = by_site(
        {
            "bbc": parse_iso(F.col("own_date")), "rt": F.coalesce(parse_iso(F.col("own_date")), parse_iso(meta("publish-date"))), "lanacion": F.coalesce(parse_iso(F.col("own_date")), usual),
            "telesur": F.coalesce(usual, parse_iso(meta("og:updated_time"))), "telemundo": F.coalesce(parse_iso(meta("article:published_time")), parse_iso(F.col("own_date"))),
        },
        usual,
    )
    rows = parsed.where(long_enough(F.col("content"), settings.min_article_chars))
    title = F.coalesce(meta("og:title"), F.col("heading"), F.col("page_title"), F.lit(""))
    return rows.select(T.source_name(F.col("url")).alias("source"), "url", T.clean_text(title).alias("title"), "content", F.array_distinct(F.coalesce(authors, none)).alias("authors"), date.alias("date"))
