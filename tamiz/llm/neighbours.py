"""Most similar vectors by shifted Hilbert curves.

Every usable vector is projected to DIMS random directions, shifted, and placed
on CURVES Hilbert curves. The keys of at most SAMPLE vectors cut each curve into
ranges of about BLOCK vectors; a vector goes to its own range and, near an end,
as an onlooker to the next one, so each vector meets at least WINDOW neighbours
on either side in key order. Inside a range the windows are scored by cosine as
matrix products; the lists of all curves are merged per vector.

A window is a share of the collection that shrinks as it grows, and what the
curves find shrinks with it. So the lists are then joined up: each vector's
neighbours are compared with each other and with it, for as many rounds as more
than REST of the entries change. This follows what the curves missed, not a size.

Vectors are packed once, as 16-bit fixed point (an error of about 1e-5 in a
cosine), and cross the network with their lists many to a record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, release

SIZE = 64
TOP = 10
DIMS, DEPTH = 8, 5  # directions of a curve, bits of each
CURVES = 4
WINDOW = 384
BLOCK = 4096
SAMPLE = 50_000  # vectors, at most, whose keys set the ranges; the driver gets their keys only
SAMPLED_A_RANGE = 16  # keys, at least, behind the borders of a range
DIRECTION = 1e4  # steps of a component, the largest being 1, under which vectors count as copies
SPREAD = 2.5  # standard deviations that a curve's grid covers on either side
MERGE_GROUPS = 64
REST = 0.1  # of the entries: a round that changes fewer is the last; the next changed a tenth as many where measured

_TIE_BITS = 23
_SEED = 7041776
_WEIGHTS = np.random.default_rng(_SEED).integers(-(2**62), 2**62, (2, SIZE)) * 2 + 1  # of a direction's steps in its hashes


def usable(embedding: Column, size: int = SIZE) -> Column:
    """Not NULL, of the right size, all components present and finite, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == size) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def hilbert_keys(cells: np.ndarray, depth: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (n, dims), numbers below 2**depth.

    The cell is turned into its transposed Hilbert index by undoing, bit by bit from the top, the
    reflections and exchanges of axes that the curve makes, then Gray-decoded and interleaved.
    """
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(depth - 1, 0, -1):
        bit, low = np.uint64(level), np.uint64((1 << level) - 1)
        for i in range(len(axes)):
            on = ((axes[i] >> bit) & one).astype(bool)
            swap = np.where(on, np.uint64(0), (axes[0] ^ axes[i]) & low)
            flip = np.where(on, low, np.uint64(0))
            axes[i] = axes[i] ^ swap
            axes[0] = axes[0] ^ swap ^ flip
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    parity = np.zeros(len(cells), np.uint64)
    for level in range(depth - 1, 0, -1):
        on = ((axes[-1] >> np.uint64(level)) & one).astype(bool)
        parity ^= np.where(on, np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(depth - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ parity) >> np.uint64(level)) & one)
    return key


class Curves:
    """Projections, scales and shifts, all from one seed; ``fit`` takes the scales from a sample."""

    def __init__(self, size: int = SIZE, curves: int = CURVES):
        rng = np.random.default_rng(_SEED)
        self.bases = [np.linalg.qr(rng.normal(size=(size, DIMS)))[0].astype(np.float32) for _ in range(curves)]
        self.shifts = [rng.uniform(0, 1, DIMS) for _ in range(curves)]
        self.scale = 1.0 / np.sqrt(size)

    def keys(self, curve: int, unit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Hilbert position, and below it a hash of the id, which lets a range end inside a crowd of equal positions."""
        flat = unit @ self.bases[curve] / self.scale
        cells = np.floor((flat + SPREAD + self.shifts[curve]) / (2 * SPREAD + 1) * (1 << DEPTH))
        place = hilbert_keys(np.clip(cells, 0, (1 << DEPTH) - 1).astype(np.uint64), DEPTH)
        with np.errstate(over="ignore"):
            tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TIE_BITS)
        return (place << np.uint64(_TIE_BITS)) | tie


def _units(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit BINARY, h1, h2) of ``vectors`` (vec_id, embedding): unit length, 16 bits a component, and two hashes
    of the direction, which rescaled copies share."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _units(batch["embedding"])
                steps = np.rint(unit / np.abs(unit).max(1, keepdims=True) * DIRECTION).astype("<i2")
                with np.errstate(over="ignore"):
                    h1, h2 = ((steps.astype(np.int64) * w).sum(1) for w in _WEIGHTS)
                short = np.round(unit * 32767).astype("<i2")
                yield pd.DataFrame({"vec_id": batch["vec_id"], "unit": [u.tobytes() for u in short], "h1": h1, "h2": h2})

    return vectors.select("vec_id", "embedding").mapInPandas(pack, "vec_id BIGINT, unit BINARY, h1 BIGINT, h2 BIGINT")


def _unpacked(column: pd.Series) -> np.ndarray:
    """Unit vectors of packed ones."""
    unit = np.frombuffer(b"".join(column), "<i2").reshape(len(column), -1).astype(np.float32)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _sampled_keys(vectors: DataFrame, total: int, curve: Curves) -> list[np.ndarray]:
    """Sorted keys of at most SAMPLE packed vectors on each curve: all that the driver ever sees of them."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit, ids = _unpacked(batch["unit"]), batch["vec_id"].to_numpy()
                yield pd.DataFrame({f"k{c}": curve.keys(c, unit, ids).view(np.int64) for c in range(len(curve.bases))})

    share = min(1.0, 0.9 * SAMPLE / total)
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE)
    found = chosen.mapInPandas(keys, ", ".join(f"k{c} BIGINT" for c in range(len(curve.bases)))).toPandas()
    return [np.sort(found[f"k{c}"].to_numpy(np.int64).view(np.uint64)) for c in range(len(curve.bases))]


def _planes(ids: np.ndarray) -> bytes:
    """64-bit numbers with equal-valued bytes side by side, which the shuffle's compression then removes."""
    return ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def window_top(unit: np.ndarray, ids: np.ndarray, core: np.ndarray, window: int = WINDOW, top: int = TOP, step: int = 256):
    """For each row of ``core`` (positions in key order): the ``top`` best of the ``window`` rows on either side.

    Yields (positions, neighbour ids, cosines); a missing neighbour has id -1 and cosine -2.
    """
    for i in range(0, len(core), step):
        own = core[i : i + step]
        lo, hi = max(0, own[0] - window), min(len(ids), own[-1] + window + 1)
        sims = unit[own] @ unit[lo:hi].T
        sims[np.arange(len(own)), own - lo] = -2
        k = min(top, hi - lo)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        score = np.take_along_axis(sims, best, 1)
        found = np.where(score > -2, ids[lo + best], -1)
        if k < top:
            score = np.pad(score, ((0, 0), (0, top - k)), constant_values=-2)
            found = np.pad(found, ((0, 0), (0, top - k)), constant_values=-1)
        yield own, found, score.astype(np.float32)


def merge_top(ids: np.ndarray, scores: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Best ``top`` of each row without repeats, by score, then by smaller id."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    scores = scores.copy()
    scores[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
    scores[ids < 0] = -2
    best = np.argsort(-scores, axis=1, kind="stable")[:, :top]
    return np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)


def nearest(vectors: DataFrame, curves: int = CURVES, window: int = WINDOW, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """(vec_id, ids ARRAY<BIGINT>, scores ARRAY<FLOAT>) of ``vectors`` (vec_id, and embedding or unit), all usable and different.

    Fewer than ``top`` other vectors give shorter arrays; one vector alone gives empty ones.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    if not total:
        return spark.createDataFrame([], "vec_id BIGINT, ids ARRAY<BIGINT>, scores ARRAY<FLOAT>")
    curve = Curves(curves=curves)
    vectors = vectors if "unit" in vectors.columns else packed(vectors)
    sorted_keys = _sampled_keys(vectors, total, curve)
    known = min(len(k) for k in sorted_keys)
    parts = max(1, min(round(total / block), max(known // SAMPLED_A_RANGE, min(known, SAMPLED_A_RANGE))))
    edges = [k[np.linspace(0, len(k), parts + 1).astype(int)[1:-1]] for k in sorted_keys]
    reach = 1.5 * window / total  # of a curve, as the sample sees it
    shared = spark.sparkContext.broadcast((curve, sorted_keys, edges))  # at most SAMPLE numbers a curve

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        on, known, ends = shared.value
        for batch in batches:
            if not len(batch):
                continue
            ids, unit = batch["vec_id"].to_numpy(), _unpacked(batch["unit"])
            short = np.frombuffer(b"".join(batch["unit"]), "<i2").reshape(len(ids), -1)
            out = []
            for c in range(len(on.bases)):
                key = on.keys(c, unit, ids)
                part = np.searchsorted(ends[c], key, side="right")
                rank = np.searchsorted(known[c], key) / max(1, len(known[c]))
                extra = len(ends[c]) and reach + 2.0 / len(known[c])
                bounds = np.concatenate(([-1.0], np.searchsorted(known[c], ends[c]) / max(1, len(known[c])), [2.0]))
                rows, target, inside = [np.arange(len(ids))], [part], [np.ones(len(ids), bool)]
                for move, near in ((-1, rank - bounds[part] <= extra), (1, bounds[part + 1] - rank <= extra)):
                    take = np.flatnonzero(near & (part + move >= 0) & (part + move <= len(ends[c])))
                    rows.append(take), target.append(part[take] + move), inside.append(np.zeros(len(take), bool))
                rows, target, inside = np.concatenate(rows), np.concatenate(target), np.concatenate(inside)
                order = np.argsort(target, kind="stable")
                cuts = np.flatnonzero(np.diff(target[order])) + 1
                for piece in np.split(order, cuts):
                    r = rows[piece]
                    out.append((c, int(target[piece[0]]), _planes(ids[r]), key[r].astype("<u8").tobytes(), inside[piece].tobytes(), short[r].tobytes()))
            yield pd.DataFrame(out, columns=["curve", "part", "ids", "keys", "inside", "unit"])

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([_unplanes(x) for x in frame["ids"]])
        keys = np.frombuffer(b"".join(frame["keys"]), "<u8")
        inside = np.frombuffer(b"".join(frame["inside"]), bool)
        unit = np.frombuffer(b"".join(frame["unit"]), "<i2").reshape(len(ids), -1)
        order = np.lexsort((ids, keys))
        ids, inside, unit = ids[order], inside[order], unit[order].astype(np.float32)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        core = np.flatnonzero(inside)
        if not len(core):
            return pd.DataFrame({"bucket": [], "own": [], "ids": [], "scores": []})
        found = list(window_top(unit, ids, core, window, top))
        own, other, scores = ids[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
        bucket = own % groups
        out = []
        for g in np.unique(bucket):
            at = np.flatnonzero(bucket == g)
            out.append((int(g), _planes(own[at]), _planes(other[at].ravel()), scores[at].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "own", "ids", "scores"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        own = np.concatenate([_unplanes(x) for x in frame["own"]])
        ids = np.concatenate([_unplanes(x).reshape(-1, top) for x in frame["ids"]])
        scores = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, top) for x in frame["scores"]])
        order = np.argsort(own, kind="stable")
        own, ids, scores = own[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        turn = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        row = np.cumsum(np.r_[True, own[1:] != own[:-1]]) - 1
        wide, worth = np.full((len(first), curves, top), -1, np.int64), np.full((len(first), curves, top), -2, np.float32)
        wide[row, turn], worth[row, turn] = ids, scores
        best, value = merge_top(wide.reshape(len(first), -1), worth.reshape(len(first), -1), top)
        keep = value > -2
        return pd.DataFrame({"vec_id": own[first], "ids": [b[k] for b, k in zip(best, keep, strict=True)], "scores": [v[k] for v, k in zip(value, keep, strict=True)]})

    groups = max(MERGE_GROUPS, total // 200_000)
    placed = vectors.mapInPandas(place, "curve INT, part INT, ids BINARY, keys BINARY, inside BINARY, unit BINARY")
    scored = placed.groupBy("curve", "part").applyInPandas(score, "bucket BIGINT, own BINARY, ids BINARY, scores BINARY")
    return scored.groupBy("bucket").applyInPandas(merge, "vec_id BIGINT, ids ARRAY<BIGINT>, scores ARRAY<FLOAT>")


def _flat(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, new: bool, groups: int) -> pd.DataFrame:
    """Single entries of lists, packed by bucket."""
    bucket = ids % groups
    at = [np.flatnonzero(bucket == g) for g in np.unique(bucket)]
    out = [(int(bucket[i[0]]), _planes(ids[i]), _planes(others[i]), scores[i].astype("<f4").tobytes(), new) for i in at]
    return pd.DataFrame(out, columns=["bucket", "own", "ids", "scores", "new"])


def _padded(lists: pd.Series, top: int) -> np.ndarray:
    sizes = np.array([len(x) for x in lists], np.int64)
    table = np.full((len(sizes), top), -1, np.int64)
    if sizes.sum():
        table[np.arange(top) < sizes[:, None]] = np.concatenate(lists.to_list())
    return table


def local_pairs(unit: np.ndarray, ids: np.ndarray, table: np.ndarray, worst: np.ndarray, own: np.ndarray, step: int = 2048):
    """(row, other row, cosine) of the pairs among each of the rows ``own`` and its list that belong on the first's list.

    ``ids`` rise; ``table`` has each row's list (-1 where it ends), ``worst`` the cosine to reach.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for i in range(0, len(own), step):
        rows = own[i : i + step]
        near = np.column_stack([ids[rows], table[rows]])
        at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
        there = ids[at] == near
        sims = unit[at] @ unit[at].transpose(0, 2, 1)
        fits = (sims >= worst[at][:, :, None]) & there[:, :, None] & there[:, None, :] & (at[:, :, None] != at[:, None, :])
        r, j, k = np.nonzero(fits)
        a, b, score = at[r, j], at[r, k], sims[r, j, k]
        fresh = ~(table[a] == ids[b][:, None]).any(1)
        found.append((a[fresh], b[fresh], score[fresh]))
    a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
    _, once = np.unique(a * len(ids) + b, return_index=True)
    return a[once], b[once], score[once].astype(np.float32)


def joined_up(vectors: DataFrame, lists: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``lists`` (vec_id, ids, scores) of ``vectors`` (vec_id, unit) after one round: neighbours of a common vector are compared.

    Adds ``fresh``, the number of entries that are new. Lists with a common leader, the id of the least hash, meet
    in one group, to which each vector goes once.
    """
    total = lists.count()
    parts, groups = max(1, total // block), max(MERGE_GROUPS, total // 200_000)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", ignore_index=True)
        ids = frame["vec_id"].to_numpy()
        unit = _unpacked(frame["unit"])
        own = np.flatnonzero((frame["home"] == frame["g"]).to_numpy())
        a, b, score = local_pairs(unit, ids, _padded(frame["ids"], top), frame["worst"].to_numpy(), own)
        return _flat(ids[a], ids[b], score, True, groups)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [len(x) for x in batch["ids"]]
            if sum(sizes):
                yield _flat(batch["vec_id"].to_numpy().repeat(sizes), np.concatenate(batch["ids"].to_list()), np.concatenate(batch["scores"].to_list()), False, groups)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        own, ids = (np.concatenate([_unplanes(x) for x in frame[c]]) for c in ("own", "ids"))
        scores = np.frombuffer(b"".join(frame["scores"]), "<f4")
        new = np.repeat(frame["new"].to_numpy(bool), [len(x) // 4 for x in frame["scores"]])
        order = np.lexsort((-scores, ids, own))
        order = order[np.r_[True, (own[order][1:] != own[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]  # each pair once
        order = order[np.lexsort((ids[order], -scores[order], own[order]))]
        own, ids, scores, new = own[order], ids[order], scores[order], new[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        turn = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        keep = turn < top
        own, ids, scores, new = own[keep], ids[keep], scores[keep], new[keep]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        return pd.DataFrame({"vec_id": own[first], "ids": np.split(ids, first[1:]), "scores": np.split(scores, first[1:]), "fresh": np.add.reduceat(new.astype(np.int64), first)})

    leader = F.array_min(F.transform(F.concat(F.array("vec_id"), "ids"), lambda x: F.xxhash64(x)))
    homes = lists.select("vec_id", "ids", "scores", F.pmod(F.xxhash64(leader), F.lit(parts)).alias("home"))
    wanted = homes.select(F.col("home").alias("g"), F.explode(F.concat(F.array("vec_id"), "ids")).alias("vec_id")).distinct()
    worst = F.when(F.size("scores") < top, F.lit(-2.0)).otherwise(F.array_min("scores")).cast("float").alias("worst")
    rows = homes.select("vec_id", "ids", worst, "home").join(vectors, "vec_id")
    flat = "bucket BIGINT, own BINARY, ids BINARY, scores BINARY, new BOOLEAN"
    met = wanted.join(rows, "vec_id").groupBy("g").applyInPandas(meet, flat)
    entries = met.unionByName(lists.select("vec_id", "ids", "scores").mapInPandas(known, flat))
    return entries.groupBy("bucket").applyInPandas(merge, "vec_id BIGINT, ids ARRAY<BIGINT>, scores ARRAY<FLOAT>, fresh BIGINT")


def neighbour_lists(store: DataFrame, top: int = TOP, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(vec_id, other BIGINT, score, rank) of every usable row of ``store`` (vec_id, embedding): its ``top`` most
    similar other rows by cosine, ties to the smaller vec_id.

    Equal vectors, and vectors of one direction, are folded into one before the curves, and unfolded in the lists: copies of the vector
    itself first, then each neighbour with its copies; only the smallest ``top`` + 1 ids of a class can
    matter and only they are kept. Rows with a vector that cannot be used have no list and are in none.
    """
    rows = store.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", "embedding")
    rows = cut(packed(rows), "vectors")
    keyed = rows.select("vec_id", "h1", "h2")
    counts = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep")).where(F.col("n") > 1)
    crowds = cut(counts.select("h1", "h2", "rep"), "crowds")
    copies = keyed.join(crowds, ["h1", "h2"]).select("rep", "vec_id")
    copies = cut(copies, "copies")
    least = copies.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (["rep", "salt"], ["rep"]):
        least = least.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= top + 1)
    few = cut(least.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "members")
    distinct = rows.select("vec_id", "unit").join(copies.where(F.col("rep") != F.col("vec_id")).select("vec_id"), "vec_id", "left_anti")
    lists = cut(nearest(distinct, window=window, block=block, top=top), "lists")
    while True:
        release(store.sparkSession)  # the shuffles behind the lists have served
        lists = cut(joined_up(distinct, lists, top, block), "lists")
        changed, entries = lists.agg(F.sum("fresh"), F.sum(F.size("ids"))).first()
        if (changed or 0) <= REST * (entries or 0):
            break
    out = lists.select("vec_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "n"))
    out = out.select("vec_id", F.col("n.ids").alias("other"), F.col("n.scores").alias("score"))
    grown = out.join(few.select(F.col("rep").alias("other"), "members"), "other", "left")
    touched = grown.where(F.col("members").isNotNull()).select("vec_id").unionByName(few.select(F.col("rep").alias("vec_id"))).distinct()
    touched = cut(touched, "touched")
    calm = out.join(touched, "vec_id", "left_anti")
    # lists that hold a copied vector, or belong to one, are unfolded
    busy = grown.join(touched, "vec_id", "left_semi").select("vec_id", F.explode(F.coalesce("members", F.array("other"))).alias("other"), "score")
    itself = few.select(F.col("rep").alias("vec_id"), F.explode("members").alias("other"), F.lit(2.0).cast("float").alias("score"))
    busy = busy.unionByName(itself).withColumn("r", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "other"))).where(F.col("r") <= top + 1)
    busy = busy.groupBy("vec_id").agg(F.collect_list(F.struct("r", "other", "score")).alias("list"))
    everyone = copies.withColumnRenamed("vec_id", "owner")
    spread = busy.join(everyone, F.col("vec_id") == F.col("rep"), "left").select(F.coalesce("owner", "vec_id").alias("vec_id"), F.sort_array("list").alias("list"))
    own = F.filter("list", lambda x: x["other"] != F.col("vec_id"))
    spread = spread.select("vec_id", F.explode(F.slice(own, 1, top)).alias("n")).select("vec_id", F.col("n.other").alias("other"), F.least(F.lit(1.0), F.col("n.score")).cast("float").alias("score"))
    return calm.unionByName(spread)


def neighbour_pairs(store: DataFrame, top: int = TOP) -> DataFrame:
    """(vec_a, vec_b), the smaller first: one of the two is on the other's list."""
    lists = neighbour_lists(store, top)
    return lists.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
