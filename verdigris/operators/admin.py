"""Relational upkeep: filters, gap-filled series, upserts, diffs, leases, checks (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import search_key


def local_day(ts: str, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """The calendar day of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(F.col(ts), zone))


def day_range(ts: str, first: str, last: str, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """Whether the timestamp's local day lies in the inclusive range; bounds on the raw column, so the scan can prune."""
    low = F.to_utc_timestamp(F.lit(first).cast("timestamp"), zone)
    high = F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), zone)
    return (F.col(ts) >= low) & (F.col(ts) < high)


def matches(columns: list[str], needle: str) -> Column:
    """Whether the columns together hold the needle, case and accents aside."""
    return F.contains(search_key(F.concat_ws(" ", *columns)), search_key(F.lit(needle)))


def daily_counts(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """One row per day of the range, days without events with 0."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counted = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return days.join(counted, "day", "left").na.fill(0, ["n"])


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both, the last per key by the order; incoming wins ties. One aggregation, no window."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rows = F.struct(*[F.col(c) for c in current.columns])
    return both.groupBy(*keys).agg(F.max_by(rows, F.struct(*order, "_new")).alias("_r")).select("_r.*")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the gone ones; null keys stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def owned(df: DataFrame, owner: str, who: Column, active: DataFrame | None = None) -> DataFrame:
    """Row-level security: the owner's rows, and only if the owner is active."""
    mine = df.where(F.col(owner) == who)
    return mine if active is None else mine.join(active.select(owner).distinct(), owner, "left_semi")


def claimable(status: str, beat: str, now: Column, stale_minutes: int = 10) -> Column:
    """Jobs that wait or failed, and running ones whose heartbeat is stale."""
    stale = F.col(beat) < now - F.make_dt_interval(mins=F.lit(stale_minutes))
    return F.col(status).isin("pending", "failed") | ((F.col(status) == "running") & F.coalesce(stale, F.lit(True)))


def audit(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, action, column, before, after): inserted, deleted and, column by column, updated values."""
    o = old.select(F.col(key), F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_o"))
    n = new.select(F.col(key), F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_n"))
    both = o.join(n, key, "full_outer")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").otherwise("update")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_o.{c}").alias("before"), F.col(f"_n.{c}").alias("after")) for c in columns])
    changed = both.select(key, action.alias("action"), F.explode(cells).alias("c"))
    return changed.where(~F.col("c.before").eqNullSafe(F.col("c.after"))).select(key, "action", "c.column", "c.before", "c.after")


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per row and failed check; a check that is null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.select(key, F.explode(failed).alias("violation"))
