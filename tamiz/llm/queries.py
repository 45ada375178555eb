"""The pN_ queries of this subpackage: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dense
from ..session import cut, work_dir
from . import boilerplate, encoding, lines, mixing, names, near_dup, neighbours, oracles, packing, splitting


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of different author strings that name the same journalist or agency."""
    return names.variant_pairs(_table(spark, folder, "search_documents").select(F.explode("authors").alias("name")))


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct author string and the entity it names."""
    return names.entities(_table(spark, folder, "search_documents").select(F.explode("authors").alias("name")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line whose wording stands in at least 8 urls of its source."""
    docs = _table(spark, folder, "search_documents")
    counts = lines.LineCounts(spark, work_dir(spark, "lines"))
    counts.update(docs)
    return counts.flagged()


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's content without its repeated lines."""
    docs = _table(spark, folder, "search_documents")
    return lines.drop_lines(docs, p3_found(spark, folder))


def p3_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that a second delta, the rows of odd numbers, changes, without their repeated lines."""
    docs = _table(spark, folder, "search_documents")
    counts = lines.LineCounts(spark, work_dir(spark, "lines"))
    counts.update(docs.where(F.col("row_id") % 2 == 0))
    crossed = counts.update(docs.where(F.col("row_id") % 2 == 1))
    return counts.rebuild(docs, crossed)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of rows whose similarity is at least 0.6."""
    return near_dup.pairs_of_rows(_table(spark, folder, "search_documents"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's group of versions and its number of links to different texts."""
    return near_dup.groups_of_rows(_table(spark, folder, "search_documents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of which one is among the ten most similar of the other."""
    return neighbours.neighbour_pairs(_table(spark, folder, "vector_store"))


def p5_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Of the vectors whose id is divisible by 50, against all by brute force: how many, and whether the lists hold nine
    tenths of their true neighbours."""
    store = _table(spark, folder, "vector_store").where(neighbours.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), "embedding")
    asked = store.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "embedding")
    true = dense.knn(store, asked, neighbours.TOP, "cosine", include_self=False).select(F.col("query_id").alias("vec_id"), F.col("id").alias("other"))
    got = neighbours.neighbour_lists(_table(spark, folder, "vector_store")).select(F.col("vec_id").alias("g_id"), F.col("other").alias("g_other"))
    met = true.join(got, (F.col("vec_id") == F.col("g_id")) & (F.col("other") == F.col("g_other")), "left")
    return met.agg(F.countDistinct("vec_id").alias("n_queries"), (F.count("g_id") >= 0.9 * F.count("*")).alias("holds"))


def _limit(spark: SparkSession, folder: str, name: str) -> tuple[int, int]:
    row = _table(spark, folder, "token_limits").where(F.col("limit_name") == name).first()
    return row["max_tokens"], row["overlap_tokens"]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk id whose content is over the chunk limit."""
    return splitting.oversized(_table(spark, folder, "chunks"), *_limit(spark, folder, "chunk"))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return splitting.split_items(_table(spark, folder, "chunks"), *_limit(spark, folder, "chunk"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of every oversized chunk: its pieces' cores tile it, no piece is over the limit, consecutive ones share the overlap."""
    most, overlap = _limit(spark, folder, "chunk")
    items = _table(spark, folder, "chunks")
    pieces = splitting.split_items(items, most, overlap).withColumn("own_tokens", splitting.token_count(F.col("piece")))
    text = items.groupBy(F.col("id").alias("t_id")).agg(F.min("content").alias("content"))
    joined = pieces.join(text, F.col("id") == F.col("t_id"))
    before = Window.partitionBy("id").orderBy("piece_no")
    joined = joined.withColumn("ended", F.coalesce(F.lag("core_end").over(before), F.lit(0))).withColumn("first", F.row_number().over(before) == 1)
    tiles = (F.col("core_start") == F.col("ended")) & (F.col("piece") == F.expr("substring(content, cast(piece_start as int) + 1, length(piece))"))
    shared = F.when(F.col("first"), F.col("n_overlap") == 0).otherwise(F.col("n_overlap") == overlap)
    whole = F.max("core_end") == F.max(F.length("content"))
    return joined.groupBy("id").agg((F.min(tiles) & whole).alias("tiles"), F.min((F.col("own_tokens") <= most) & (F.col("own_tokens") == F.col("n_tokens"))).alias("fits"), F.min(shared).alias("overlaps"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-blank line that is not part of the article."""
    return boilerplate.outside_main(_table(spark, folder, "search_documents"), _table(spark, folder, "sites"))


def p7_main(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's article: the content without the lines of ``p7_found``."""
    return lines.drop_lines(_table(spark, folder, "search_documents"), p7_found(spark, folder))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of every row with content: the non-blank lines of the article, and those outside, together."""
    docs = _table(spark, folder, "search_documents")
    outside = cut(boilerplate.outside_main(docs, _table(spark, folder, "sites")), "outside")
    kept = lines.drop_lines(docs, outside).where(F.col("content").isNotNull())
    n_kept = kept.select("row_id", F.size(F.filter(F.split("content", "\n", -1), lambda x: lines.collapse(x) != "")).alias("n"))
    both = n_kept.unionByName(outside.select("row_id", F.lit(1).alias("n")))
    return both.groupBy("row_id").agg(F.sum("n").alias("n_lines"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text's container; a text over the capacity in as few parts as possible."""
    capacity, _ = _limit(spark, folder, "container")
    return packing.pack(packing.measured_pieces(_table(spark, folder, "documents"), capacity), capacity)


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, containers that any packing needs, and the share of space unused."""
    capacity, _ = _limit(spark, folder, "container")
    return packing.packing_report(p8_containers(spark, folder), capacity)


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents placed, containers over the capacity, texts cut without need or into too many parts, and whether the
    containers are within a hundredth of the fewest."""
    capacity, _ = _limit(spark, folder, "container")
    packed = cut(p8_containers(spark, folder), "packed")
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n_over"))
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("n_pieces").alias("n_pieces"))
    fewest = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity))
    texts = texts.agg(F.count("*").alias("n_docs"), F.count_if((F.col("pieces") != fewest) | (F.col("n_pieces") != fewest)).alias("n_cut"))
    near = packing.packing_report(packed, capacity).select((F.col("containers") <= F.ceil(F.col("lower_bound") * 1.01)).alias("near_bound"))
    return texts.crossJoin(over).crossJoin(near)


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: every use of a text, and its slot."""
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return mixing.share_report(p9_mix(spark, folder), _table(spark, folder, "mix_targets"))


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of every source: no text over its cap, and the share within three of the longest texts of its target."""
    targets = _table(spark, folder, "mix_targets")
    mixed = cut(p9_mix(spark, folder), "mixed")
    sums = mixed.agg(F.sum("n_tokens").alias("whole"), F.max("n_tokens").alias("longest"))
    shares = mixing.share_report(mixed, targets).join(targets.select(F.col("source").alias("t_source"), "max_repeats"), F.col("source") == F.col("t_source")).crossJoin(F.broadcast(sums))
    near = F.abs(F.col("actual_share") - F.col("target_share")) * F.col("whole") <= 3 * F.col("longest")
    return shares.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("cap_kept"), near.alias("share_met"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with a stretch read in a wrong encoding."""
    return encoding.garbled(_table(spark, folder, "documents"))


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every such document's likeliest chain and restored text."""
    return encoding.restored(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_entities": p2_entities,
    "p3_found": p3_found,
    "p3_cleaned": p3_cleaned,
    "p3_rebuilt": p3_rebuilt,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_recall": p5_recall,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_checks": p6_checks,
    "p7_found": p7_found,
    "p7_main": p7_main,
    "p7_checks": p7_checks,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_checks": p8_checks,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

ORACLES: dict[str, str] = oracles.ORACLES
