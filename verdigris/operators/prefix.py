"""Running totals within groups of any size, without one task per group.

A group is split into buckets by the caller's order. Totals per bucket are
pre-aggregated and summed along the buckets, which is a small table; within a
bucket a window adds the rest. A group that holds a third of all rows is then
spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one.

    ``bucket`` must ascend with the order. Nulls in ``value`` count as 0.
    """
    amount = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    along = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(along), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = df.withColumn("_near", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return near.join(offsets, [*group, bucket]).withColumn(out, F.col("_offset") + F.col("_near")).drop("_offset", "_near")


def most_frequent(counts: DataFrame, key: str, count: str, size: int, buckets: int = 256) -> DataFrame:
    """At most ``size`` rows: of each hash bucket of keys the most frequent, ties by key.

    Unlike a global top list, which takes ``size`` rows from every partition to
    the driver, no more than ``size`` rows ever come together.
    """
    w = Window.partitionBy("_bucket").orderBy(F.col(count).desc(), key)
    ranked = counts.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).withColumn("_n", F.row_number().over(w))
    return ranked.where(F.col("_n") <= max(1, size // buckets)).drop("_bucket", "_n")
