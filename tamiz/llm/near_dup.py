"""Near-duplicate documents: banded MinHash candidates, odd-sketch estimates, exact check.

Equal texts are folded into one first, and then texts with the same set of word
triples into one class. Each class gets K MinHash values over its triples; bands of R of them propose candidate pairs, an
odd sketch (parity bitmap of all K values) estimates each pair's similarity from
the population count of the XOR, and pairs near or over the threshold are
checked exactly on the triples of those few documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components

THRESHOLD = 0.6
WORDS = 3
ROWS, BANDS = 5, 100  # a pair at 0.6 is proposed with probability 1 - (1 - 0.6**5)**100 = 0.9997
HASHES = ROWS * BANDS
BITS = 1024  # of an odd sketch
WORDS_KEPT = 200_000
SLACK = 0.12  # below the threshold, about four standard errors of the estimate

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """Hashes of the words met so far, at most WORDS_KEPT of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` consecutive words; empty below that many."""
    found = _WORD.findall(text.lower())
    if len(found) < words:
        return np.zeros(0, _U)
    hashed = np.fromiter(map(_hashes.__getitem__, found), _U, len(found))
    n = len(found) - words + 1
    total = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for i in range(words):
            total = total * _U(0x9E3779B97F4A7C15) + hashed[i : i + n]
        return np.unique(_mix(total))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240517)
    return rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def minhash(sh: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    """K minima of 32-bit hashes; the triples go through in blocks, so a very long text needs no more memory."""
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    x = (sh >> _U(32)).astype(np.uint32)
    for i in range(0, len(x), block):
        hashed = np.multiply(x[i : i + block, None], a)
        hashed += b
        np.minimum(low, hashed.min(0), out=low)
    return low


def odd_sketch(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmap of the (position, value) pairs, as signed 64-bit words."""
    with np.errstate(over="ignore"):
        at = _mix(low.astype(_U) + _U(0x9E3779B97F4A7C15) * np.arange(1, len(low) + 1, dtype=_U)) % _U(bits)
    parity = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.arange(1, BANDS + 1, dtype=_U)
        for part in low.reshape(BANDS, ROWS).T:
            keys = keys * _U(0xD6E8FEB86659FD93) + part
        return _mix(keys).view(np.int64)


def estimate(a: Column, b: Column, hashes: int = HASHES, bits: int = BITS) -> Column:
    """Similarity from two odd sketches: 1 + n/(4k) ln(1 - 2x/n), with x the population count of the XOR."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    inside = F.greatest(F.lit(1e-9), 1 - 2 * apart / F.lit(float(bits)))
    return 1 + F.lit(bits / (4 * hashes)) * F.log(inside)


def _full_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("content"))


def texts_of_rows(docs: DataFrame) -> DataFrame:
    """(row_id, text_id): each row with non-empty content, and the smallest row_id of the same title and content."""
    rows = docs.where(F.col("row_id").isNotNull() & F.col("content").isNotNull() & (F.col("content") != ""))
    rows = rows.select("row_id", F.xxhash64(_full_text()).alias("k1"), F.xxhash64(F.lit("b"), _full_text()).alias("k2"))
    least = rows.groupBy("k1", "k2").agg(F.min("row_id").alias("text_id"))
    return rows.join(least, ["k1", "k2"]).select("row_id", "text_id")


def signatures(docs: DataFrame) -> DataFrame:
    """(text_id, s1, s2, keys, sketch) of every row of ``docs`` (row_id, text) with at least one triple; s1 and s2 are
    hashes of the set of triples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients()
        for batch in batches:
            out = []
            for row_id, text in zip(batch["row_id"], batch["text"], strict=True):
                sh = shingles(text or "")
                if len(sh):
                    low = minhash(sh, a, b)
                    whole = sh.tobytes()
                    out.append((row_id, xxhash.xxh64_intdigest(whole) - 2**63, xxhash.xxh64_intdigest(whole, 1) - 2**63, band_keys(low), odd_sketch(low)))
            yield pd.DataFrame(out, columns=["text_id", "s1", "s2", "keys", "sketch"])

    return docs.mapInPandas(run, "text_id BIGINT, s1 BIGINT, s2 BIGINT, keys ARRAY<BIGINT>, sketch ARRAY<BIGINT>")


def signed_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``signatures`` of the different texts of ``docs``, and ``rep``, the smallest text_id of the same set of triples."""
    own = texts.where(F.col("row_id") == F.col("text_id")).select(F.col("row_id").alias("m_row"))
    chosen = docs.select("row_id", _full_text().alias("text")).join(own, F.col("row_id") == F.col("m_row"), "left_semi")
    signed = cut(signatures(chosen), "signatures")
    least = signed.groupBy("s1", "s2").agg(F.min("text_id").alias("rep"))
    return signed.join(least, ["s1", "s2"]).select("text_id", "rep", "keys", "sketch")


def similar_classes(docs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep_a, rep_b, similarity) of the pairs of different sets of triples at or over ``threshold``.

    ``signed`` is ``signed_texts``. All band collisions become candidates, without a cap; a crowded
    band key is split by the adaptive skew join.
    """
    signed = signed.where(F.col("text_id") == F.col("rep"))
    bands = signed.select("rep", F.explode("keys").alias("key"))
    left, right = bands.select("key", F.col("rep").alias("rep_a")), bands.select("key", F.col("rep").alias("rep_b"))
    pairs = left.join(right, "key").where(F.col("rep_a") < F.col("rep_b")).select("rep_a", "rep_b").distinct()
    for side in ("a", "b"):
        sketch = signed.select(F.col("rep").alias(f"rep_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(sketch, f"rep_{side}")
    close = pairs.where(estimate(F.col("sketch_a"), F.col("sketch_b")) >= threshold - SLACK).select("rep_a", "rep_b")
    close = cut(close, "close")
    wanted = close.select(F.col("rep_a").alias("w")).unionByName(close.select(F.col("rep_b").alias("w"))).distinct()
    few = docs.select("row_id", _full_text().alias("text")).join(wanted, F.col("row_id") == F.col("w"), "left_semi")

    @F.pandas_udf("binary")
    def triples(text: pd.Series) -> pd.Series:
        return text.map(lambda t: shingles(t or "").tobytes())

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, _U), np.frombuffer(q, _U)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out)

    sets = cut(few.select("row_id", triples("text").alias("sh")), "triples")
    for side in ("a", "b"):
        close = close.join(sets.select(F.col("row_id").alias(f"rep_{side}"), F.col("sh").alias(f"sh_{side}")), f"rep_{side}")
    checked = close.select("rep_a", "rep_b", jaccard("sh_a", "sh_b").alias("similarity"))
    return checked.where(F.col("similarity") >= threshold)


def pairs_of_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_a, row_b), the smaller first, of all rows with non-empty content whose similarity reaches
    ``threshold``; rows of fewer than three words have no triples and no pair, rows without a row_id take
    no part. Extra columns are ignored."""
    texts = cut(texts_of_rows(docs), "texts")
    signed = cut(signed_texts(docs, texts), "signed")
    links = similar_classes(docs, signed, threshold).select("rep_a", "rep_b")
    members = cut(texts.join(signed.select("text_id", "rep"), "text_id").select("row_id", "rep"), "members")
    crowds = members.groupBy("rep").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    links = links.unionByName(crowds.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")))
    a = members.select(F.col("rep").alias("rep_a"), F.col("row_id").alias("x"))
    b = members.select(F.col("rep").alias("rep_b"), F.col("row_id").alias("y"))
    rows = links.join(a, "rep_a").join(b, "rep_b").where((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
    return rows.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))


def groups_of_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, group_id, n_links) of every row with non-empty content: the smallest row_id that links lead to,
    and the number of different texts it is similar to. A row without links is a group of its own.

    Links are found and counted between sets of triples; neither copies nor texts of one set are paired.
    """
    texts = cut(texts_of_rows(docs), "texts")
    signed = cut(signed_texts(docs, texts), "signed")
    links = cut(similar_classes(docs, signed, threshold).select("rep_a", "rep_b"), "links")
    found = components(links, "rep_a", "rep_b")
    sizes = cut(signed.groupBy("rep").agg(F.count("*").alias("n_texts"), F.min("text_id").alias("least")), "sizes")
    ends = links.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(links.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    degree = ends.join(sizes.select(F.col("rep").alias("other"), "n_texts"), "other").groupBy("rep").agg(F.sum("n_texts").alias("n_other"))
    per_class = sizes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    links_of = F.coalesce("n_other", F.lit(0).cast("long")) + F.col("n_texts") - 1
    per_class = per_class.select("rep", F.coalesce("component", "rep").alias("group_id"), links_of.alias("n_links"))
    per_text = signed.select("text_id", "rep").join(per_class, "rep").select("text_id", "group_id", "n_links")
    rows = texts.join(per_text, "text_id", "left")
    return rows.select("row_id", F.coalesce("group_id", "text_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def expected_recall(similarity: float) -> float:
    return 1 - math.pow(1 - similarity**ROWS, BANDS)
