"""Texts in containers of fixed capacity, by bound-certified repacking.

Items are hashed into partitions of a bounded number, and each partition is
packed by best-fit decreasing. Dual feasible functions give a lower bound on the
number of bins any packing of the partition needs; a partition that meets its
bound is finished. From the others the bins with a gap are opened, their items
change partitions, and best fit decreasing runs again, until every partition is
certified or the rounds are over.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import DEFAULT_VOCABULARY, share
from .tokens import count as tokens_of

PARTITION_ITEMS = 2048  # of one packing task, on average
FULL = 0.99  # of the capacity: a bin without a gap worth an exchange
ITEM = "doc_id BIGINT, piece_no INT, n_pieces INT, n_tokens BIGINT"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of three families of dual feasible functions.

    Each function u keeps sum(u) <= 1 over every set of items that fits one bin, so the sum over all
    items, rounded up, is a bound: the identity; rounding at 1/(k+1) steps; and, for each threshold
    e <= capacity/2, items over capacity - e as whole bins and items under e as nothing.
    """
    sizes = np.sort(sizes[sizes > 0].astype(np.int64))
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    for k in range(1, 12):
        steps = (k + 1) * sizes
        value = np.where(steps % capacity == 0, sizes * k, (steps // capacity) * capacity)
        best = max(best, -(-int(value.sum()) // (capacity * k)))
    sums = np.concatenate(([0], np.cumsum(sizes)))
    for e in np.unique(np.concatenate((sizes[sizes <= capacity // 2], capacity - sizes[sizes > capacity // 2]))):
        low, high = np.searchsorted(sizes, e, "left"), np.searchsorted(sizes, capacity - e, "right")
        best = max(best, len(sizes) - int(high) + -(-int(sums[high] - sums[low]) // capacity) if high >= low else 0)
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: largest first, into the fullest bin that has room."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # distinct room, ascending
    by_room: dict[int, list[int]] = {}
    bins = 0
    for i in order:
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            room, b = capacity, bins
            bins += 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        out[i] = b
        left = room - size
        if left in by_room:
            by_room[left].append(b)
        else:
            by_room[left] = [b]
            bisect.insort(rooms, left)
    return out


def measured_pieces(docs: DataFrame, capacity: int, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, n_pieces, n_tokens): one item a text, or as few as possible of one that exceeds
    ``capacity`` alone. NULL and empty texts are one item of 0 tokens; rows without a doc_id are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                n = tokens_of(text, vocabulary)
                pieces = max(1, -(-n // capacity))
                out += [(doc_id, p, pieces, min(capacity, n - p * capacity)) for p in range(pieces)]
            yield pd.DataFrame(out, columns=["doc_id", "piece_no", "n_pieces", "n_tokens"])

    share(docs.sparkSession, vocabulary)
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, ITEM)


def _packer(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
        sizes = frame["n_tokens"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        frame = frame.assign(bin=bins, used=used[bins])
        frame["certified"] = len(used) <= max(1, lower_bound(sizes, capacity))
        return frame

    return run


def pack(items: DataFrame, capacity: int, partition_items: int = PARTITION_ITEMS, full: float = FULL) -> DataFrame:
    """(container_id, doc_id, piece_no, n_pieces, n_tokens, container_tokens, certified) of every item.

    ``certified``: the container's partition has as few containers as any packing of it could have.
    An item is never split here; ``items`` must hold none over ``capacity``. Items of equal size are
    taken in the order of their ids, so the same input gives the same containers. No items, no rows.
    A partition keeps its bins over ``full`` and gives up the others.
    """
    items = cut(items, "items")
    count = items.count()
    schema = f"{ITEM}, part BIGINT, bin BIGINT, used BIGINT, certified BOOLEAN"
    todo, done, turn = items, [], 0
    while True:
        parts = max(1, round(count / partition_items))
        spread = todo.select("doc_id", "piece_no", "n_pieces", "n_tokens", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(turn)), F.lit(parts)).alias("part"))
        packed = cut(spread.groupBy("part").applyInPandas(_packer(capacity), schema), f"packed{turn}").withColumn("turn", F.lit(turn))
        settled = F.col("used") >= capacity * full  # of a certified partition, too, one bin may have a gap
        bins = packed.select("part", "bin", settled.alias("settled")).distinct().agg(F.count("*").alias("all"), F.count_if(~F.col("settled")).alias("open")).first()
        # an exchange that fills as many bins as it was given has saved none; one that fills more is not taken
        if parts == 1 or not bins["open"] or (turn and bins["all"] >= opened):
            done.append(todo if turn and bins["all"] > opened else packed)
            break
        done.append(packed.where(settled))
        todo, opened, turn = packed.where(~settled), bins["open"], turn + 1
        count = todo.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.concat_ws("-", "turn", "part", "bin").alias("container_id"),
        "doc_id",
        "piece_no",
        "n_pieces",
        "n_tokens",
        F.col("used").alias("container_tokens"),
        "certified",
    )


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, least possible containers by the sizes' histogram, share of space unused."""
    histogram = packed.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()  # at most capacity + 1 rows
    bound = histogram_bound(histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), capacity)
    total = packed.agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    unused = F.coalesce(1 - F.try_divide(F.col("tokens"), F.col("containers") * capacity), F.lit(0.0))
    return total.select("containers", "tokens", F.lit(int(bound)).cast("long").alias("lower_bound"), unused.alias("unused_share"))


def histogram_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of the whole collection from its size histogram."""
    keep = sizes > 0
    sizes, counts = sizes[keep], counts[keep]
    if not len(sizes):
        return 0
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 12):
        steps = (k + 1) * sizes
        value = np.where(steps % capacity == 0, sizes * k, (steps // capacity) * capacity)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    for e in range(1, capacity // 2 + 1):
        whole = int(counts[sizes > capacity - e].sum())
        middle = (sizes >= e) & (sizes <= capacity - e)
        best = max(best, whole + -(-int((sizes[middle] * counts[middle]).sum()) // capacity))
    return best
