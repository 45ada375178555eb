"""Oversized items cut at natural boundaries, by agglomerative merging.

An item's tokens start as segments of their own. The boundary between two
neighbouring segments has a strength: nothing between the tokens, a blank, a
clause, a sentence, a line, a paragraph. Neighbouring pairs wait in a heap, and
the weakest boundary (of those, the smallest pair, then the leftmost) is merged
while the merged segment plus the overlap fits the limit. What remains are the
pieces; each but the first starts with the last ``overlap`` tokens before it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
_LAST_WORD = re.compile(r"\w+$")
_CLAUSE = frozenset(",;:)»”–—")
_SENTENCE = frozenset(".!?…")
_CLOSERS = frozenset("\"'”’»)]")

# Spanish abbreviations after whose full stop a sentence goes on.
ABBREVIATIONS = frozenset(
    "sr sra srta sres sras dr dra dres ing lic prof profa art arts núm núms nro pág págs cap vol ed eds cía av avda aprox ej etc ee uu".split()
)

NOTHING, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

PIECE = "piece_no INT, core_start BIGINT, core_end BIGINT, piece_start BIGINT, n_tokens BIGINT, n_overlap BIGINT, piece STRING"


def token_count(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, and other single non-blank characters, in ``text``."""
    words = F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))
    others = F.regexp_count(text, F.lit(r"(?U)[^\p{L}\p{N}_\s\x{1c}-\x{1f}]"))
    return (words + others).cast("long")


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary after each token but the last."""
    out = []
    for (start, end), (follow, _) in zip(spans, spans[1:], strict=False):
        gap = text[end:follow]
        if not gap:
            out.append(NOTHING)
            continue
        newlines = gap.count("\n")
        if newlines:
            out.append(PARAGRAPH if newlines > 1 else LINE)
            continue
        last, at = text[end - 1], end - 1
        while text[at] in _CLOSERS and at > 0:
            at -= 1
        closes = text[at] in _SENTENCE and not text[follow].islower()
        if closes and text[at] == ".":
            word = _LAST_WORD.search(text, max(0, at - 12), at)
            word = word[0].lower() if word else ""
            closes = not (word in ABBREVIATIONS or len(word) == 1 and word.isalpha())
        out.append(SENTENCE if closes else CLAUSE if last in _CLAUSE else BLANK)
    return out


def _merge(sizes: list[int], strengths: list[int], room: int, first_room: int, least_first: int) -> list[int]:
    """Sizes of the merged segments. ``room``: most tokens of a segment; ``first_room``: of the first one."""
    n = len(sizes)
    size = list(sizes)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    stamp = [0] * n
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and size[i] + size[j] <= (first_room if i == 0 else room):
            # the head takes what it needs to hold an overlap before anything else
            level = -1 if i == 0 and size[0] < least_first else strengths[j - 1]
            heapq.heappush(heap, (level, size[i] + size[j], i, stamp[i], stamp[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, _, i, si, sj = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or stamp[i] != si or j >= n or stamp[j] != sj:
            continue
        size[i] += size[j]
        alive[j] = False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        stamp[i] += 1
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [size[i] for i in range(n) if alive[i]]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int, int, str]]:
    """Pieces (number, core start, core end, piece start, tokens, overlap tokens, piece) of one text.

    The cores tile the text from its first to its last character; a piece is its overlap and its core.
    A text within the limit is one piece, a text without tokens too. Every piece has at most ``limit``
    tokens, and every piece but the first starts with exactly ``overlap`` tokens of what precedes it.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, 0, len(text), 0, len(spans), 0, text)]
    strengths = boundaries(text, spans)
    room = limit - overlap
    # runs that end at a sentence or more and fit are merged whole before any such boundary is touched
    sizes, between, run = [], [], [0]
    runs = []
    for i, s in enumerate(strengths, 1):
        if s >= SENTENCE:
            runs.append((run[0], i))
            run = [i]
    runs.append((run[0], len(spans)))
    for start, end in runs:
        steps = [end - start] if end - start <= room else [1] * (end - start)
        for size in steps:
            if sizes:
                between.append(strengths[start - 1])
            sizes.append(size)
            start += size
    merged = _merge(sizes, between, room, limit, min(overlap, room))
    pieces, at = [], 0
    for number, size in enumerate(merged):
        begin, stop = at, at + size
        taken = min(overlap, begin)
        core_start = 0 if number == 0 else spans[begin][0]
        core_end = len(text) if stop == len(spans) else spans[stop][0]
        piece_start = core_start if number == 0 else spans[begin - taken][0]
        pieces.append((number, core_start, core_end, piece_start, size + taken, taken, text[piece_start : spans[stop - 1][1] if stop < len(spans) else len(text)]))
        at = stop
    return pieces


def split_items(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(id, piece columns) of the items of ``items`` (id, content) that have more than ``limit`` tokens.

    Rows that repeat an id count once (the smallest content, as text). NULL and empty contents and
    items within the limit give no rows; extra columns are ignored. Sizes are counted by column
    expressions; only oversized items reach Python.
    """
    large = items.where(token_count(F.col("content")) > limit).select("id", "content")
    large = large.groupBy("id").agg(F.min("content").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "piece_no", "core_start", "core_end", "piece_start", "n_tokens", "n_overlap", "piece"]
        for batch in batches:
            for item, text in zip(batch["id"], batch["content"], strict=True):
                yield pd.DataFrame([(item, *p) for p in split_text(text, limit, overlap)], columns=names)

    return large.mapInPandas(run, f"id STRING, {PIECE}")


def oversized(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(id) of the items that came out in more than one piece."""
    return split_items(items, limit, overlap).where(F.col("piece_no") == 1).select("id")
