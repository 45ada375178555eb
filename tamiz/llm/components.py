"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node that ``edges`` names; a component's name is its smallest node.

    Each round takes the least label among a node's neighbours (a partial aggregation, so a node of
    very many links is combined before the shuffle) and then that label's own label, so paths halve.
    Every round ends in a written table. NULL ends and self-links are ignored.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(links.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct()
    links = cut(links, "links")
    labels = cut(links.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "node"), "labels")
    for _ in range(rounds):
        near = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("src"), "left").select("node", "label", F.least("label", "near").alias("to"))
        over = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        step = step.join(over, "to", "left").select("node", F.col("label").alias("was"), F.least("to", "far").alias("label"))
        step = cut(step, "labels")
        labels = step.select("node", "label")
        if step.where(F.col("was") != F.col("label")).limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
