"""Windows and joins along time; batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per time window; with ``slide`` the windows overlap."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(
        F.col("w.start").alias("start"), *keys, "n", "total"
    )


def sessions(df: DataFrame, ts: str, gap_minutes: int, key: str) -> DataFrame:
    """(key, start, last, n): events of a key no farther apart than the gap."""
    grouped = df.groupBy(F.session_window(ts, f"{gap_minutes} minutes").alias("w"), key)
    return grouped.agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n")).select(key, "start", "last", "n")


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tie: str, span: str = "day") -> DataFrame:
    """Left rows with the right side's last value at or before their time.

    Both sides are one sorted stream per key and span of time: a union and one
    window instead of a range join, so the work is linear, and a frequent key is
    spread over its spans. A row without a value in its own span takes the last
    one of the spans before. At equal times the right side counts as before.
    Left rows without a value before them, or without a time, get null.
    """
    columns = [c for c in left.columns]
    bucket = F.date_trunc(span, F.col(ts))
    l = left.select(*columns, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_left"))  # noqa: E741
    r = right.where(F.col(ts).isNotNull()).select(
        *[F.col(c) if c in (key, ts, tie) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns], F.col(value).alias("_v"), F.lit(0).alias("_left")
    )
    both = l.unionByName(r).withColumn("_span", bucket)
    near = Window.partitionBy(key, "_span").orderBy(ts, "_left", tie).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_near", F.last("_v", ignorenulls=True).over(near)).where("_left = 1")
    spans = both.groupBy(key, "_span").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(ts, tie))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(F.col(key).alias("_key"), F.col("_span").alias("_at"), "_carried")
    joined = filled.join(carried, filled[key].eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_at")), "left")
    return joined.withColumn("as_of", F.when(F.col(ts).isNotNull(), F.coalesce("_near", "_carried"))).select(*columns, "as_of")
