"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
import re
import tempfile

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("TAMIZ_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

PATTERN_FILE = "token_pattern.txt"
_RUN = re.compile(r"\S{4097}|\s{4097}")
_PARTS = re.compile(r"(?:(?:\s{1,4096}(?!\s))?\S{1,4096}|\s{1,4096})")


def share(spark: SparkSession, vocabulary: str = DEFAULT_VOCABULARY) -> None:
    """Send the vocabulary and its pattern to executors that may not have them on their own disks, once an application."""
    import public_tokenizers

    one = (spark.sparkContext.applicationId, vocabulary)
    if spark.sparkContext.master.startswith("local") or one in _shared:
        return
    pattern = os.path.join(tempfile.mkdtemp(prefix="tamiz-ship-"), PATTERN_FILE)
    with open(pattern, "w", encoding="utf-8") as out:
        out.write(public_tokenizers.PATTERN)
    spark.sparkContext.addFile(vocabulary)
    spark.sparkContext.addFile(pattern)
    _shared.add(one)


_shared: set[tuple[str, str]] = set()


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The byte-level BPE whose ranks are in ``vocabulary``, a path here or the name of a file that was sent."""
    if not os.path.exists(vocabulary):
        vocabulary = SparkFiles.get(os.path.basename(vocabulary))
    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        with open(SparkFiles.get(PATTERN_FILE), encoding="utf-8") as sent:
            pattern = sent.read()
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str = DEFAULT_VOCABULARY) -> list[int]:
    """Token ids. A run of over 4,096 characters without a change between blank and not is encoded in blocks of
    so many, since the merges of one word take time in proportion to its square."""
    own = encoder(vocabulary)
    if not _RUN.search(text):
        return own.encode_ordinary(text)
    out: list[int] = []
    for part in _PARTS.findall(text):
        out += own.encode_ordinary(part)
    return out


def count(text: str | None, vocabulary: str = DEFAULT_VOCABULARY) -> int:
    return len(encode(text, vocabulary)) if text else 0


def token_size(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens; 0 for NULL and empty texts."""

    @F.pandas_udf("bigint")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t, vocabulary) for t in texts], dtype="int64")

    return size(text)
