"""Sources mixed to target weights by a low-discrepancy schedule.

Each source's texts are shuffled and laid end to end, pass after pass up to the
source's cap, and cut into blocks of equal tokens (a text belongs to the block
in which its middle lies). Slot j of the mix takes the j-th golden-ratio point,
frac((j + 1/2) * phi), mapped through the cumulative target shares to a source; the r-th
slot of a source takes the source's r-th block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .prefix import running_sum
from .tokens import DEFAULT_VOCABULARY, share, token_size

BLOCK_TOKENS = 256
BUCKET_ROWS = 50_000  # uses in one window of a running sum, on average
SLOTS_A_BUCKET = 16384
PHI = 0.6180339887498949  # the golden ratio less one


def sized_texts(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the texts of the target sources; a text that several rows repeat counts
    once (the smallest doc_id), NULL and empty texts not at all."""
    wanted = targets.select(F.col("source").alias("t_source")).distinct()
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "source", "text")
    rows = rows.join(wanted, F.col("source") == F.col("t_source"), "left_semi")
    first = rows.groupBy(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("b"), "text").alias("k2")).agg(F.min("doc_id").alias("first"))
    first = cut(first.select("first"), "texts")
    rows = rows.join(first, F.col("doc_id") == F.col("first"), "left_semi")
    share(docs.sparkSession, vocabulary)
    sized = rows.select("doc_id", "source", token_size(F.col("text"), vocabulary).alias("n_tokens"))
    return sized.where(F.col("n_tokens") > 0)


def plan(sized: DataFrame, targets: DataFrame) -> dict:
    """The mix's size: the most tokens that no source's cap forbids, and each source's part of them.

    ``targets`` has one row a source and is read to the driver; so are the sources' token sums.
    Shares are scaled to sum to 1; sources without texts or with a share of 0 are left out, and the
    others keep their proportions.
    """
    sums = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rows = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("cap")).collect()
    rows = [r for r in rows if r["share"] and r["share"] > 0 and r["cap"] and r["cap"] > 0 and sums.get(r["source"])]
    whole = sum(r["share"] for r in rows)
    sources = sorted(((r["source"], r["share"] / whole, int(r["cap"]), sums[r["source"]]) for r in rows), key=lambda r: r[0])
    total = int(min((cap * tokens / share for _, share, cap, tokens in sources), default=0))
    return {"sources": sources, "total": total}


def schedule(spark: SparkSession, shares: list[tuple[str, float]], slots: int) -> DataFrame:
    """(slot, source, turn): the source of each slot, and the slot's rank among its source's, from 0."""
    slot = F.col("slot")
    # frac(slot * phi) in two halves, exact enough up to 2**40 slots
    high, low = F.shiftrightunsigned(slot, 20), slot.bitwiseAND(F.lit((1 << 20) - 1))
    point = F.lit(0.5) + low * F.lit(PHI) + high * F.lit((1 << 20) * PHI % 1.0)
    upto, pick = 0.0, F.lit(shares[-1][0])
    steps = []
    for source, share in shares[:-1]:
        upto += share
        steps.append((source, upto))
    for source, end in reversed(steps):
        pick = F.when(F.col("point") < end, source).otherwise(pick)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point - F.floor(point)).withColumn("source", pick)
    points = points.withColumn("bucket", F.floor(slot / SLOTS_A_BUCKET)).withColumn("one", F.lit(1))
    return running_sum(points, "source", "bucket", ["slot"], "one", "turn").select("slot", "source", "turn")


def blocks(spark: SparkSession, sized: DataFrame, sources: list[tuple], block_tokens: int, slots: int) -> DataFrame:
    """(source, block, pass, doc_id, n_tokens): every use of every text that the schedule can reach, in its block.

    A source is laid out for as many passes as its share of ``slots`` takes (and two slots more, by which a
    low-discrepancy schedule may be off), at most its cap.

    A pass is shuffled by a hash; its top bits, more of them for a larger source, are the buckets of the
    running sum.
    """
    most = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    bits = max(4, min(24, (most // BUCKET_ROWS).bit_length()))
    passes = lambda share, cap, tokens: max(1, min(cap, math.ceil((share * slots + 2) * block_tokens / tokens)))
    caps = spark.createDataFrame([(source, passes(share, cap, tokens)) for source, share, cap, tokens in sources], "c_source STRING, cap INT")
    uses = sized.join(F.broadcast(caps), F.col("source") == F.col("c_source")).select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("cap") - 1)).alias("pass"))
    uses = uses.withColumn("at", F.xxhash64("doc_id", "pass"))
    uses = uses.withColumn("bucket", F.col("pass").cast("long") * (1 << bits) + F.shiftrightunsigned("at", 64 - bits))
    laid = running_sum(uses, "source", "bucket", ["at", "doc_id"], "n_tokens", "start")
    middle = F.col("start") + F.col("n_tokens") / 2
    return laid.select("source", F.floor(middle / block_tokens).alias("block"), "pass", "doc_id", "n_tokens")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, pass, doc_id, n_tokens) of the mix: which text stands in which slot, and for which time.

    Nothing usable gives no rows. A source's share misses its target by little more than one text and one block.
    """
    spark = docs.sparkSession
    sized = cut(sized_texts(docs, targets, vocabulary), "sized")
    found = plan(sized, targets)
    if not found["total"]:
        return spark.createDataFrame([], "slot BIGINT, source STRING, pass INT, doc_id BIGINT, n_tokens BIGINT")
    slots = max(1, found["total"] // block_tokens)
    timetable = schedule(spark, [(s[0], s[1]) for s in found["sources"]], slots)
    laid = blocks(spark, sized, found["sources"], block_tokens, slots)
    turn = timetable.select("slot", F.col("source").alias("s_source"), F.col("turn").alias("s_turn"))
    joined = laid.join(turn, (F.col("source") == F.col("s_source")) & (F.col("block") == F.col("s_turn")))
    return joined.select("slot", "source", "pass", "doc_id", "n_tokens")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_uses, most_uses) of every target source."""
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n_tokens"))
    sums = uses.groupBy(F.col("source").alias("u_source")).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("uses").alias("n_uses"), F.max("uses").alias("most_uses"))
    whole = F.broadcast(sums.agg(F.sum("n_tokens").alias("whole")))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share")).join(sums, F.col("source") == F.col("u_source"), "left").crossJoin(whole)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.select("source", "target_share", F.coalesce(F.try_divide("n_tokens", "whole"), F.lit(0.0)).alias("actual_share"), zero("n_tokens"), zero("n_uses"), zero("most_uses"))
