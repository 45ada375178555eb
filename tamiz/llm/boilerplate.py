"""Main content of pages by tag-path ratios, for texts whose tags are gone.

The lines of a page stand for the leaves of its tree. Each line gets a path from the root to the leaf, built from what
the text still shows: the kind of node (menu, account, list item, spoken line, numbered link, hash tags, text that
closes or runs long, other text), its label or opening words, and its whole wording with site names, hosts and digits
masked. Over the whole collection, text length and punctuation are added up for each path at each level; wording that
comes again in its source counts once, so a template's text is spread over all pages that show it. The two ratios, per node and beside
those of running text, are fused as their product.

A line takes the ratio of its kind, smoothed along the page; each deeper level of its path then has its own say, the
more the more pages stand behind it (EVIDENCE pages weigh as much as all that is above). What comes out under THRESHOLD
is not main content. No list of words takes part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

THRESHOLD = 0.35  # of the ratio of running text
WEIGHTS = (0.25, 0.5, 0.25)
EVIDENCE = 16  # pages behind a level of a path that weigh as much as all above it
LONG_LINE = 140  # a line of so many characters is running text even without its full stop
LABEL_WORDS, OPENING_WORDS = 3, 4
MOST_CHARS, MOST_PUNCT = 1000, 25  # of one line in the sums, so that no single line makes a path's ratio
MASKED = 3  # a host or site name is masked if it is longer

KINDS = "LQ#AMOPT"
L, Q, HASH, ACCOUNT, MENU, NUMBERED, RUNNING, TEXT = range(len(KINDS))
CARRIED = (L, Q)  # hang on the text around them
OWN_TAG = (HASH, ACCOUNT, MENU, NUMBERED)  # their form alone is a tag of its own

# Spanish articles, with which a label does not start.
ARTICLES = frozenset("el la los las un una unos unas lo".split())

NODE = "row_id BIGINT, line_no BIGINT, url_key BIGINT, source_key BIGINT, k1 BIGINT, k2 BIGINT, kind INT, lead BIGINT, is_label BOOLEAN, n_chars INT, n_punct INT"

_DIGITS = re.compile(r"\d+")
_CLOSES = re.compile(r"[.?!…][”\"»')\]]*$")
_ACCOUNT = re.compile(r"@?\w*_\w*[ :]")
_LABEL = re.compile(r"\(?([^:.?!”]{1,28}):")
_SEPARATORS = re.compile(r"[|·/»>]")
_NUMBER = re.compile(r"0[.)] ")
_PUNCTUATION = re.compile(r"[.,;:?!¿¡“”()—–-]")


def masked(line: str, host: str, name: str) -> str:
    """Small letters, single blanks, the host as ``«h»``, the site's name as ``«s»``, each run of digits as ``0``."""
    text = " ".join(line.lower().split())
    if len(host) > MASKED:
        text = text.replace(host, "«h»")
    if len(name) > MASKED:
        text = text.replace(name, "«s»")
    return _DIGITS.sub("0", text)


def path_of(m: str) -> tuple[int, str, bool]:
    """(kind, label or opening words, whether it is a label) of a masked line: the levels of its path above the wording."""
    closes = bool(_CLOSES.search(m))
    marks = len(_SEPARATORS.findall(m)) if not closes and len(m) < 160 else 0
    if m[0] in "-•*" and m[1:2] == " ":
        kind = L
    elif m[0] in "—–":
        kind = Q
    elif m[0] == "#":
        kind = HASH
    elif _ACCOUNT.match(m):
        kind = ACCOUNT
    elif marks and len(m) < 16 * (marks + 1):
        kind = MENU
    elif not closes and _NUMBER.match(m):
        kind = NUMBERED
    else:
        kind = RUNNING if closes or len(m) >= LONG_LINE else TEXT
    label = _LABEL.match(m)
    if label:
        words = label[1].split()
        if 0 < len(words) <= LABEL_WORDS and words[0] not in ARTICLES:
            return kind, words[0], True
    return kind, " ".join(m.split(" ", OPENING_WORDS)[:OPENING_WORDS]) if closes else "", False


def line_nodes(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per non-blank line (see NODE): its place, hashes of its wording, its path, its text length and punctuation.
    ``lead`` is a hash of kind and label or opening, NULL where a line has neither."""
    names = sites.groupBy(F.col("source").alias("s_source")).agg(F.min("site_name").alias("site_name"))
    docs = docs.where(F.col("row_id").isNotNull() & F.col("content").isNotNull()).select("row_id", "url", "source", "content")
    docs = docs.join(names, F.col("source") == F.col("s_source"), "left")
    url_key = F.when(F.col("url").isNotNull(), F.xxhash64("url")).otherwise(F.col("row_id"))
    docs = docs.select("row_id", url_key.alias("url_key"), F.xxhash64("source").alias("source_key"), F.coalesce("source", F.lit("")).alias("host"), F.coalesce("site_name", F.lit("")).alias("name"), "content")
    digest = lambda text, seed: xxhash.xxh64_intdigest(text, seed) - (1 << 63)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d in batch.itertuples(index=False):
                host, name = d.host.lower(), " ".join(d.name.lower().split())
                for n, line in enumerate(d.content.split("\n"), 1):
                    m = masked(line, host, name)
                    if m:
                        kind, lead, is_label = path_of(m)
                        key = digest(f"{kind}{lead}", 2) if lead else None
                        out.append((d.row_id, n, d.url_key, d.source_key, digest(m, 0), digest(m, 1), kind, key, is_label, min(MOST_CHARS, len(m)), min(MOST_PUNCT, len(_PUNCTUATION.findall(m)))))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])
            yield frame.astype({"lead": "Int64"})

    return docs.mapInPandas(run, NODE)


def wordings(nodes: DataFrame) -> DataFrame:
    """(k1, k2, kind, lead, n_chars, n_punct, pages, again): every wording once, the pages that show it, and how many of
    those are not the first of their source: an article that many sites took over once each is no template."""
    same = [F.first(c).alias(c) for c in ("kind", "lead", "n_chars", "n_punct")]
    pages = nodes.groupBy("k1", "k2", "source_key", "url_key").agg(*same)
    by_source = pages.groupBy("k1", "k2", "source_key").agg(*same, F.count("*").alias("pages"))
    return by_source.groupBy("k1", "k2").agg(*same, F.sum("pages").alias("pages"), F.sum(F.col("pages") - 1).alias("again"))


def ratio(chars, punct, pages):
    """Text length and punctuation per page, fused."""
    return (chars / pages) * ((punct + 0.1) / pages)


def _judged(u0: np.ndarray, own: np.ndarray, kind: np.ndarray, page: np.ndarray, label: np.ndarray, r2, c2, r3, c3) -> np.ndarray:
    """Scores of lines in order: ``u0`` and ``own`` are the ratio of the kind and its weight, r2 c2 of label or opening,
    r3 c3 of the wording, ``page`` the number of the line's page."""

    def deepen(v: np.ndarray) -> np.ndarray:
        for r, c in ((u0, own), (r2, c2), (r3, c3)):
            v = c * r + (1 - c) * v
        return v

    value = deepen(u0)
    # a label within a text (a credit, a link) does not part it
    solid = np.flatnonzero(~(label & (c2 * (1 - r2) >= 0.5) & (c3 < 0.5)))
    v, p = value[solid], page[solid]
    hangs = np.isin(kind[solid], CARRIED)
    if hangs.any():
        # a list or a dialogue takes the value of the text it hangs on
        given = v.copy()
        for order in (range(len(v)), range(len(v) - 1, -1, -1)):
            carried, at = 0.0, -1
            for i in order:
                if p[i] != at:
                    carried, at = 0.0, p[i]
                if hangs[i]:
                    v[i] = max(v[i], carried)
                else:
                    carried = given[i]
    above = np.where(np.r_[False, p[1:] == p[:-1]], np.r_[0.0, v[:-1]], 0.0)
    below = np.where(np.r_[p[1:] == p[:-1], False], np.r_[v[1:], 0.0], 0.0)
    smooth = np.zeros(len(u0))
    smooth[solid] = WEIGHTS[0] * above + WEIGHTS[1] * v + WEIGHTS[2] * below
    return np.where(np.isin(kind, CARRIED), smooth, deepen(smooth))


def outside_main(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """(row_id, line_no) of every non-blank line of ``content`` that is not main content.

    NULL, empty and blank contents and rows without a row_id give no rows; a page without any running text comes out whole.
    Path statistics are aggregated on the map side; a page is put together again from its line
    numbers and ratios, not its text.
    """
    nodes = cut(line_nodes(docs, sites), "nodes")
    texts = cut(wordings(nodes), "wordings")
    fresh = F.col("pages") - F.col("again")
    sums = [F.sum("pages").alias("pages"), F.sum(F.col("n_chars") * fresh).alias("chars"), F.sum(F.col("n_punct") * fresh).alias("punct")]
    kinds = {r["kind"]: (r["pages"], ratio(r["chars"], r["punct"], r["pages"])) for r in texts.groupBy("kind").agg(*sums).collect()}  # at most len(KINDS) rows
    running = kinds.get(RUNNING, (0, 1.0))[1]
    of_kind = np.array([min(1.0, kinds.get(k, (0, 0.0))[1] / running) for k in range(len(KINDS))])
    weight = np.array([kinds.get(k, (0, 0.0))[0] / (kinds.get(k, (0, 0.0))[0] + EVIDENCE) if k in OWN_TAG else 0.0 for k in range(len(KINDS))])
    relative = lambda r: F.least(F.lit(1.0), r / F.lit(running)).cast("float")
    behind = lambda n: (n / (n + F.lit(EVIDENCE))).cast("float")
    leads = texts.where(F.col("lead").isNotNull()).groupBy("lead").agg(*sums).where(F.col("pages") > 1)
    leads = leads.select(F.col("lead").alias("l_lead"), relative(ratio(F.col("chars"), F.col("punct"), F.col("pages"))).alias("r2"), behind(F.col("pages") - 1).alias("c2"))
    shown = F.col("again") + 1
    again = texts.where(F.col("again") > 0).select(F.col("k1").alias("w_k1"), F.col("k2").alias("w_k2"), relative(ratio(F.col("n_chars"), F.col("n_punct"), shown)).alias("r3"), behind(F.col("again")).alias("c3"))
    lines = nodes.select("row_id", "line_no", "k1", "k2", "kind", "lead", "is_label")
    lines = lines.join(again, (F.col("k1") == F.col("w_k1")) & (F.col("k2") == F.col("w_k2")), "left")
    # lines without a label or opening, a third and more of all, take no part in the join
    led = lines.where(F.col("lead").isNotNull()).join(leads, F.col("lead") == F.col("l_lead"), "left")
    lines = led.unionByName(lines.where(F.col("lead").isNull()), allowMissingColumns=True)
    zero = lambda c: F.coalesce(c, F.lit(0.0).cast("float")).alias(c)
    fields = ["line_no", "kind", "is_label", "r2", "c2", "r3", "c3"]
    node = F.struct("line_no", F.col("kind").cast("byte").alias("kind"), "is_label", *[zero(c) for c in fields[3:]])
    pages = lines.groupBy("row_id").agg(F.sort_array(F.collect_list(node)).alias("n")).select("row_id", *[F.col(f"n.{c}").alias(c) for c in fields])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["line_no"].map(len).to_numpy()
            flat = {c: np.concatenate(batch[c].to_list()) for c in fields}
            kind = flat["kind"].astype(int)
            score = _judged(of_kind[kind], weight[kind], kind, np.repeat(np.arange(len(batch)), sizes), flat["is_label"].astype(bool), *(flat[c].astype(float) for c in fields[3:]))
            out = score < THRESHOLD
            yield pd.DataFrame({"row_id": np.repeat(batch["row_id"].to_numpy(), sizes)[out], "line_no": flat["line_no"][out]})

    return pages.mapInPandas(judge, "row_id BIGINT, line_no BIGINT")
