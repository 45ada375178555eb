"""Text read in a wrong character encoding: found and restored by expectation-maximization.

A garbled stretch went through a chain: it was written in one encoding and read
in another, once or several times. The chain of a record is latent. A character
bigram model gives the likelihood of a record's suspicious words as they stand
and as each chain would undo them; each source (and field) has its own chain
weights. The E-step computes every record's chain posterior, the M-step pools
the posteriors into the sources' weights, and the bigram model is trained again
without the records found garbled. Each record is repaired by its posterior.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Encodings that text is taken for, and those it was really in, by their codec names.
READ_AS = "cp1252 cp1250 cp1251 cp1253 cp1254 cp1257 iso8859_2 iso8859_5 iso8859_7 mac_roman cp437 cp850 cp866 koi8_r".split()
AGAIN = "cp1252 mac_roman cp437 cp850".split()  # also twice and three times
WRITTEN_IN = "cp1252 mac_roman cp437 cp850".split()

CLEAN = 0.9  # share of records taken for clean before the first step
SMOOTHING = 20.0  # records' worth of the overall weights that each source starts with
STEPS = 4
RARE = 3e-3  # only a word with a bigram less likely than this may be in another alphabet's bytes
MOST = 60.0  # a word's log-likelihood ratio counts for no more
INNER_CAPITAL = np.log(0.002)  # a capital after a small letter
LOST = "�"

_BLANKS = re.compile(r"[ \t\r\n\f\v]+")
_LETTER = re.compile(r"[A-Za-z]")


@functools.cache
def _table(codec: str) -> tuple[list[str], dict[str, int]]:
    """Characters of the bytes 0-255 (undefined bytes as control characters), and bytes of the characters."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {chr(b): b for b in range(0x80, 0xA0)}
    back.update({c: b for b, c in enumerate(chars) if b >= 0x80})
    return chars, back


@functools.cache
def _undoes(codec: str) -> re.Pattern:
    """What a word must hold for ``undo_utf8`` to change it: a first byte of a UTF-8 sequence and its followers, or one
    of two-byte letters whose follower is gone, as they look in ``codec``."""
    _, back = _table(codec)

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in back.items() if low <= b <= high) + "]"

    follow = chars(0x80, 0xBF)
    whole = f"{chars(0xC2, 0xDF)}{follow}|{chars(0xE0, 0xEF)}{follow}{{2}}|{chars(0xF0, 0xF4)}{follow}{{3}}"
    return re.compile(f"{whole}|{chars(0xC3, 0xC3)}(?:[A-Za-z]|\\Z)")


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def undo_utf8(word: str, codec: str) -> str:
    """``word`` with each run that is UTF-8 read as ``codec`` decoded; what is not stays.

    A lead byte whose follower is gone (a soft hyphen that was dropped) gives the letter it must have been.
    """
    _, back = _table(codec)
    data = [back.get(c, -1) if c > "\x7f" else ord(c) for c in word]
    out, i = [], 0
    while i < len(word):
        n = _length(data[i]) if data[i] >= 0xC2 else 0
        if n and i + n <= len(word) and all(0x80 <= b <= 0xBF for b in data[i + 1 : i + n]):
            try:
                out.append(bytes(data[i : i + n]).decode("utf-8"))
                i += n
                continue
            except UnicodeDecodeError:
                pass
        if data[i] == 0xC3 and (i + 1 == len(word) or word[i + 1].isalpha() and word[i + 1] < "\x7f"):
            out.append("à" if i + 1 == len(word) else "í")
        else:
            out.append(word[i])
        i += 1
    return "".join(out)


def undo_single(word: str, written: str, read: str) -> str:
    chars, _ = _table(written)
    _, back = _table(read)
    return "".join(chars[back[c]] if c in back else c for c in word)


@functools.cache
def chains() -> list[tuple[str, tuple]]:
    """(name, steps) of every chain but the identity; a step undoes one wrong reading."""
    found = [(f"utf-8 as {c}", (("utf8", c),)) for c in READ_AS]
    found += [(f"utf-8 as {c} x{n}", (("utf8", c),) * n) for c in AGAIN for n in (2, 3)]
    found += [(f"{w} as {r}", (("single", w, r),)) for w in WRITTEN_IN for r in READ_AS if w != r]
    return found + [("lost", ())]


def undo(word: str, steps: tuple) -> str:
    for step in steps:
        word = undo_utf8(word, step[1]) if step[0] == "utf8" else undo_single(word, step[1], step[2])
    return word


@functools.cache
def _symbols() -> tuple[np.ndarray, int]:
    """Symbol of each code point: small Latin letters and marks of their own, other characters by kind."""
    names: dict[str, int] = {}
    table = np.zeros(0x110000, np.uint16)
    other = names.setdefault("other", 0)
    table[:] = other
    for point in range(0x3000):
        c = chr(point)
        low = c.lower() if len(c.lower()) == 1 else c
        if point < 0x250 or 0x2010 <= point <= 0x2027 or c in "€™−":
            key = "0" if c.isdigit() and point < 0x80 else " " if c in " \t\r\n\f\v" else low
        else:
            kind = unicodedata.name(c, "none").split()[0]
            key = kind if kind in ("CYRILLIC", "GREEK", "BOX", "COMBINING", "ARABIC", "HEBREW") else unicodedata.category(c)
        table[point] = names.setdefault(key, len(names))
    table[0x3000:0xA000] = names.setdefault("CJK", len(names))
    table[0x10000:] = names.setdefault("high", len(names))
    return table, len(names)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


CHARS_AT_ONCE = 1 << 20


def _pair_counts(texts: list[str], table: np.ndarray, n: int) -> np.ndarray:
    """Counts of symbol pairs of ``texts``, each between two blanks."""
    s = table[_codes("".join(f" {t} " for t in texts))].astype(np.int64)
    counts = np.bincount(s[:-1] * n + s[1:], minlength=n * n)
    blank = int(table[ord(" ")])
    counts[blank * n + blank] -= len(texts) - 1  # between two texts
    return counts


def bigram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of symbol pairs over all of ``texts`` (text). The driver gets at most as many numbers as
    there are pairs of symbols, some 700 squared; each task sends its own sums, added up by a group-by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, n = _symbols()
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch["text"]:
                if text:
                    held.append(text)
                    size += len(text)
                if size >= CHARS_AT_ONCE:
                    total += _pair_counts(held, table, n)
                    held, size = [], 0
            if held:
                total += _pair_counts(held, table, n)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "times": total[at]})

    rows = texts.select("text").mapInPandas(run, "pair BIGINT, times BIGINT").groupBy("pair").agg(F.sum("times").alias("times")).toPandas()
    _, n = _symbols()
    counts = np.zeros(n * n)
    counts[rows["pair"].to_numpy(np.int64)] = rows["times"].to_numpy(float)
    return counts.reshape(n, n)


class Model:
    """Log-probabilities of symbol pairs, and the chains' verdicts on words, kept by word."""

    def __init__(self, counts: np.ndarray, weight: float = 2.0):
        unigram = counts.sum(0) + 0.5
        unigram /= unigram.sum()
        rows = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + weight * unigram) / (rows + weight)).astype(np.float32)

    def __getstate__(self):
        return {"logp": self.logp}

    def __setstate__(self, state):
        self.logp = state["logp"]

    def score(self, word: str) -> tuple[float, float]:
        """Log-likelihood of a word between blanks, and of its least likely pair."""
        codes = _codes(f" {word} ")
        table, _ = _symbols()
        s = table[codes]
        pairs = self.logp[s[:-1], s[1:]]
        least = float(pairs.min())
        total = float(pairs.sum())
        if not word.islower() and not word.isupper():
            inner = sum(1 for a, b in zip(word, word[1:], strict=False) if a.islower() and b.isupper())
            if inner:
                total += inner * INNER_CAPITAL
                least = min(least, INNER_CAPITAL - 2)
        return total, least

    def verdict(self, word: str) -> np.ndarray | None:
        """Log-likelihood ratio of each chain against the word as it stands; None for a word of no interest."""
        cache = self.__dict__.setdefault("cache", {})
        if word in cache:
            return cache[word]
        if len(cache) > 200_000:
            cache.clear()
        total, least = self.score(word)
        # a mark that stands alone is no evidence for another alphabet
        single = (least < np.log(RARE) or "\xa0" in word) and bool(_LETTER.search(word))
        out = np.zeros(len(chains()), np.float32)
        gains = {word: 0.0}
        for i, (_, steps) in enumerate(chains()):
            if not steps:
                if LOST in word:
                    out[i] = MOST
                continue
            if not single if steps[0][0] == "single" else not _undoes(steps[0][1]).search(word):
                continue
            fixed = undo(word, steps)
            if fixed not in gains:  # many chains give the same
                gains[fixed] = min(MOST, self.score(fixed)[0] - total)
            out[i] = gains[fixed]
        if out.max() <= 0:
            out = None
        cache[word] = out
        return out


def high_words(text: str) -> list[str]:
    """Words between ASCII blanks that have a character beyond ASCII."""
    return [w for w in _BLANKS.split(text) if not w.isascii()]


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, scores): each chain's log-likelihood ratio for the whole record, NULL without evidence.

    A chain may hold for part of a record: a word counts as log((1 + ratio) / 2), and against no chain.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pairs of symbols: of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            scores = []
            for text in batch["text"]:
                total = None
                for word in high_words(text or ""):
                    v = own.verdict(word)
                    if v is not None:
                        gain = np.logaddexp(0.0, np.maximum(v, 0.0)) - np.log(2.0)
                        total = gain if total is None else total + gain
                scores.append(None if total is None else total.astype(np.float32))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "scores": scores})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id BIGINT, source STRING, scores ARRAY<FLOAT>")


def _posterior(scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of (clean, chain 1, ...) from log-likelihood ratios and weights."""
    joint = np.concatenate((np.zeros((len(scores), 1)), scores), axis=1) + np.log(weights)
    joint -= joint.max(1, keepdims=True)
    joint = np.exp(joint)
    return joint / joint.sum(1, keepdims=True)


def _stack(frame: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(frame[column].to_numpy()).astype(float)


def chain_weights(found: DataFrame, steps: int = STEPS) -> DataFrame:
    """(w_source, weights): each source's shares of clean records and of each chain, after ``steps`` of EM.

    Records without evidence count as clean. A step pools posteriors inside each task and then by source.
    """
    spark = found.sparkSession
    n = len(chains()) + 1
    base = np.r_[CLEAN, np.full(n - 1, (1 - CLEAN) / (n - 1))]
    sums = found.groupBy("source").agg(F.count("*").alias("n"), F.count("scores").alias("n_seen"))
    sums = cut(sums, "sources")
    held = found.where(F.col("scores").isNotNull())
    weights = sums.select(F.col("source").alias("w_source"), F.array(*[F.lit(float(x)) for x in base]).alias("weights"))

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                r = _posterior(_stack(batch, "scores"), _stack(batch, "weights"))
                batch = batch.assign(source=batch["source"].astype(object).where(batch["source"].notna(), None))
                for source, rows in batch.reset_index(drop=True).groupby("source", dropna=False).indices.items():
                    yield pd.DataFrame({"source": [None if pd.isna(source) else source], "r": [r[rows].sum(0)]})

    def maximize(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"source": [frame["source"].iloc[0]], "r": [_stack(frame, "r").sum(0)]})

    for _ in range(steps):
        joined = held.join(weights, F.col("source").eqNullSafe(F.col("w_source")))
        pooled = joined.select("source", "scores", "weights").mapInPandas(expect, "source STRING, r ARRAY<DOUBLE>")
        pooled = cut(pooled.groupBy("source").applyInPandas(maximize, "source STRING, r ARRAY<DOUBLE>"), "pooled")
        overall = pooled.select(F.posexplode("r").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        clean = sums.agg(F.sum(F.col("n") - F.col("n_seen")).alias("c")).first()["c"] or 0
        whole = base * SMOOTHING
        whole[0] += clean
        whole[overall["i"].to_numpy(int)] += overall["x"].to_numpy(float)
        whole /= whole.sum()
        prior = F.array(*[F.lit(float(x) * SMOOTHING) for x in whole])
        rows = sums.join(pooled.select(F.col("source").alias("p_source"), "r"), F.col("source").eqNullSafe(F.col("p_source")), "left")
        none = F.array(*[F.lit(0.0)] * n)
        total = F.zip_with(F.coalesce("r", none), prior, lambda x, y: x + y)
        unseen = (F.col("n") - F.col("n_seen")).cast("double")
        total = F.transform(total, lambda x, i: F.when(i == 0, x + unseen).otherwise(x))
        scale = F.col("n").cast("double") + F.lit(SMOOTHING)
        weights = cut(rows.select(F.col("source").alias("w_source"), F.transform(total, lambda x: x / scale).alias("weights")), "weights")
    return weights


def posteriors(docs: DataFrame, rounds: int = 2) -> tuple[DataFrame, Model]:
    """(doc_id, clean, log_posterior) of the records with evidence, and the bigram model of the last round."""
    texts = docs.select("doc_id", "source", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = whole = bigram_counts(texts)
    for turn in range(rounds):
        model = Model(counts)
        found = cut(evidence(texts, model), "evidence")
        weights = chain_weights(found)
        joined = found.where(F.col("scores").isNotNull()).join(weights, F.col("source").eqNullSafe(F.col("w_source")))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    p = _posterior(_stack(batch, "scores"), _stack(batch, "weights"))
                    yield pd.DataFrame({"doc_id": batch["doc_id"], "clean": p[:, 0], "log_posterior": list(np.log(np.maximum(p[:, 1:], 1e-12)).astype(np.float32))})

        judged = cut(joined.select("doc_id", "scores", "weights").mapInPandas(judge, "doc_id BIGINT, clean DOUBLE, log_posterior ARRAY<FLOAT>"), "judged")
        if turn + 1 < rounds:
            # what the garbled records have is taken off the sums of all
            bad = judged.where(F.col("clean") < 0.5).select(F.col("doc_id").alias("bad")).distinct()
            counts = whole - bigram_counts(texts.join(bad, F.col("doc_id") == F.col("bad"), "left_semi"))
    return judged, model


def garbled(docs: DataFrame) -> DataFrame:
    """(doc_id) of every record of ``docs`` (doc_id, source, text) with a stretch read in a wrong encoding.

    NULL and empty texts, texts in ASCII alone and rows without a doc_id never count; a NULL source is a source
    of its own. Copies are judged alike.
    """
    judged, _ = posteriors(docs)
    return judged.where(F.col("clean") < 0.5).select("doc_id")


def restored(docs: DataFrame) -> DataFrame:
    """(doc_id, chain, text, complete) of every garbled record: its likeliest chain and its text with each
    suspicious word undone by the chain that its own evidence and the record's posterior favour.
    ``complete`` is false where characters were lost for good."""
    judged, model = posteriors(docs)
    bad = judged.where(F.col("clean") < 0.5).select(F.col("doc_id").alias("j_doc"), "log_posterior")
    joined = docs.select("doc_id", "text").join(bad, F.col("doc_id") == F.col("j_doc"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known = shared.value, chains()
        for batch in batches:
            rows = []
            for doc_id, text, weight in zip(batch["doc_id"], batch["text"], batch["log_posterior"], strict=True):
                weight = np.maximum(np.asarray(weight, float), -6.0)
                used: Counter = Counter()

                def fix(match: re.Match, weight=weight, used=used) -> str:
                    word = match[0]
                    for _ in range(3):  # what one chain leaves garbled, another may undo
                        v = None if word.isascii() else own.verdict(word)
                        if v is None:
                            break
                        gain = np.where(v > 0, v + weight, -np.inf)
                        better = undo(word, known[int(gain.argmax())][1])
                        if gain.max() <= -3 or better == word:
                            break
                        # of chains that give the same, the first in the list is the simplest
                        used[next(name for name, steps in known if undo(word, steps) == better)] += 1
                        word = better
                    return word

                fixed = re.sub(r"[^ \t\r\n\f\v]+", fix, text)
                chain = used.most_common(1)[0][0] if used else known[int(np.argmax(weight))][0]
                rows.append((doc_id, chain, fixed, LOST not in fixed))
            yield pd.DataFrame(rows, columns=["doc_id", "chain", "text", "complete"])

    return joined.select("doc_id", "text", "log_posterior").mapInPandas(run, "doc_id BIGINT, chain STRING, text STRING, complete BOOLEAN")
