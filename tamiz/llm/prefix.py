"""Running sums over ordered groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come before this one.

    ``bucket`` is a number by which ``order`` already sorts the rows coarsely. Sums per (group, bucket)
    are small; a window runs over them, and another inside each bucket, so a group with a third of all
    rows is spread over its buckets.
    """
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    df = df.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return df.withColumn(out, (F.col("__s") + F.col("__i")).cast("long")).drop("__g", "__b", "__s", "__i")
