"""Sentence chunks with overlap, as the vector index takes them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..config import Settings
from ..schema import CHUNK

_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
# Abbreviations after which a sentence goes on.
ABBREVIATIONS = {"sr.", "sra.", "srta.", "dr.", "dra.", "lic.", "ing.", "prof.", "art.", "núm.", "pág.", "av.", "etc."}

SPECIAL_TOKENS = 2  # that a model's tokenizer puts around every sentence


def sentences(text: str) -> list[str]:
    """Sentences without outer blanks, empty ones left out; an abbreviation's full stop ends none."""
    out: list[str] = []
    for part in _SENTENCE.split(text):
        part = part.strip()
        if not part:
            continue
        if out and out[-1].rsplit(None, 1)[-1].lower() in ABBREVIATIONS:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text)) + SPECIAL_TOKENS


def split_long(unit: str, max_tokens: int) -> list[str]:
    """A unit over the limit in windows of ``max_tokens`` tokens, without overlap."""
    spans = [m.span() for m in _TOKEN.finditer(unit)]
    room = max(1, max_tokens - SPECIAL_TOKENS)
    return [unit[spans[i][0] : spans[min(i + room, len(spans)) - 1][1]] for i in range(0, len(spans), room)]


def pack_units(counts: list[int], max_tokens: int, overlap: int) -> list[list[int]]:
    """Indices of the units of each chunk: greedy up to the limit; on overflow the next chunk starts with the
    longest run of last units that fits the overlap, and takes the new unit in any case, so it may be larger."""
    chunks: list[list[int]] = []
    now: list[int] = []
    total = 0
    for i, n in enumerate(counts):
        if now and total + n > max_tokens:
            chunks.append(now)
            kept: list[int] = []
            size = 0
            for j in reversed(now):
                if size + counts[j] > overlap:
                    break
                kept.insert(0, j)
                size += counts[j]
            now, total = kept, size
        now.append(i)
        total += n
    if now:
        chunks.append(now)
    return chunks


def chunk_document(title: str | None, content: str | None, max_tokens: int, overlap: int, counter: Callable[[str], int] = count_tokens) -> list[tuple[str, int]]:
    """(text, tokens) of each chunk of title and content; nothing but blanks gives none."""
    units: list[str] = []
    for s in sentences(f"{title or ''}\n\n{content or ''}"):
        units += [s] if counter(s) <= max_tokens else split_long(s, max_tokens)
    counts = [counter(u) for u in units]
    return [(" ".join(units[i] for i in c), sum(counts[i] for i in c)) for c in pack_units(counts, max_tokens, overlap)]


def chunk(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks (id, content, metadata) of ``docs`` (url, source, title, content, authors, date as text); ids are
    ``url_number`` from 0."""
    limit, overlap = settings.max_tokens, settings.overlap_tokens

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d in batch.itertuples(index=False):
                authors = [] if d.authors is None else list(d.authors)
                for n, (text, tokens) in enumerate(chunk_document(d.title, d.content, limit, overlap)):
                    meta = {"doc_id": d.url, "source": d.source, "title": d.title or "", "publication_date": d.date, "authors": authors, "chunk_number": n, "estimated_tokens": tokens}
                    rows.append((f"{d.url}_{n}", text, meta))
            yield pd.DataFrame(rows, columns=["id", "content", "metadata"])

    return docs.select("url", "source", "title", "content", "authors", docs["date"].cast("string").alias("date")).mapInPandas(run, CHUNK)
