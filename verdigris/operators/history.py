"""Conversations: memory windows, facts, pairs, caches, snapshots (H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigris.session import cut, map_batches


def memory(df: DataFrame, conversation: str, order: list[str], value: Column, size: int = 3) -> Column:
    """The values of the last ``size`` turns, the current one last."""
    w = Window.partitionBy(conversation).orderBy(*order).rowsBetween(-(size - 1), 0)
    return F.collect_list(value).over(w)


def last_facts(df: DataFrame, conversation: str, facts: str, order: list[str]) -> DataFrame:
    """(conversation, fact, value): every fact with the value stated last. Aggregated map-side; null values never replace."""
    stated = df.select(conversation, *order, F.explode(facts).alias("fact", "value")).where("value IS NOT NULL")
    return stated.groupBy(conversation, "fact").agg(F.max_by("value", F.struct(*order)).alias("value"))


def followed(df: DataFrame, conversation: str, order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds what the next turn of the conversation holds, under the given names."""
    w = Window.partitionBy(conversation).orderBy(*order)
    return df.withColumns({name: F.lead(c).over(w) for c, name in columns.items()})


#: Asks of one key that are walked through in one task; keys with more go by jumps.
WALKED = 10_000


class _Walk:
    """Asks of a key in order: a miss stores the time, a hit doesn't renew it."""

    def __init__(self, micros: int):
        self.micros = micros

    def __call__(self, batch):
        out: dict = {"cache_key": [], "_ts": [], "_new": []}
        for key, times in zip(batch["cache_key"], batch["times"]):
            stored = None
            for ts in sorted(times):
                new = stored is None or ts - stored > self.micros
                stored = ts if new else stored
                out["cache_key"].append(key)
                out["_ts"].append(ts)
                out["_new"].append(new)
        return out


def _jumped(asks: DataFrame, micros: int) -> DataFrame:
    """The asks (cache_key, _ts), each once, that store: those reached from a key's first by jumping to the first ask past the time to live.

    A key's asks are split into spans of one time to live. The first ask past an
    ask's time is looked for in the next span, else it is the first of a later
    one; then jumps are squared until nothing new is reached.
    """
    span = F.floor(F.col("_ts") / micros)
    marked = asks.withColumn("_span", span)
    first_of = marked.groupBy("cache_key", "_span").agg(F.min("_ts").alias("_first"))
    later = first_of.withColumn("_later", F.lead("_first").over(Window.partitionBy("cache_key").orderBy("_span"))).select("cache_key", "_span", "_later")
    ends = asks.withColumn("_end", F.col("_ts") + micros).withColumn("_span", F.floor(F.col("_end") / micros))
    both = marked.select("cache_key", "_span", F.col("_ts").alias("_at"), F.lit(None).cast("bigint").alias("_of")).unionByName(
        ends.select("cache_key", "_span", F.col("_end").alias("_at"), F.col("_ts").alias("_of"))
    )
    after = Window.partitionBy("cache_key", "_span").orderBy("_at").rangeBetween(1, Window.unboundedFollowing)
    near = both.withColumn("_next", F.min(F.when(F.col("_of").isNull(), F.col("_at"))).over(after)).where("_of IS NOT NULL")
    # A span without asks has no later one of its own; the last span before it has.
    starts = first_of.select("cache_key", "_span", F.col("_first").alias("_found"))
    missing = near.where("_next IS NULL").select("cache_key", F.col("_of").alias("_ts"), "_span")
    line = missing.select("cache_key", "_span", "_ts", F.lit(None).cast("bigint").alias("_found")).unionByName(starts.select("cache_key", "_span", F.lit(None).cast("bigint").alias("_ts"), "_found"))
    beyond = Window.partitionBy("cache_key").orderBy("_span").rangeBetween(1, Window.unboundedFollowing)
    further = line.withColumn("_next", F.min("_found").over(beyond)).where("_ts IS NOT NULL AND _next IS NOT NULL").select("cache_key", "_ts", "_next")
    jump = cut(near.where("_next IS NOT NULL").select("cache_key", F.col("_of").alias("_ts"), "_next").unionByName(further))
    reached = asks.groupBy("cache_key").agg(F.min("_ts").alias("_ts"))
    known = -1
    while True:
        reached = cut(reached.unionByName(reached.join(jump, ["cache_key", "_ts"]).select("cache_key", F.col("_next").alias("_ts"))).distinct())
        count = reached.count()
        if count == known:
            return reached.withColumn("_new", F.lit(True))
        known = count
        jump = _squared(jump)


def _squared(jump: DataFrame) -> DataFrame:
    twice = jump.select("cache_key", F.col("_ts").alias("_next"), F.col("_next").alias("_far"))
    return cut(jump.join(twice, ["cache_key", "_next"]).select("cache_key", "_ts", F.col("_far").alias("_next")))


def cache_hits(df: DataFrame, key: Column, ts: str, order: list[str], ttl_hours: int = 6, walked: int = WALKED) -> DataFrame:
    """Adds the key's digest and whether the answer was in the cache: stored within the time to live before.

    The time counts from the ask that stored the answer; hits don't renew it.
    Of asks at one moment the first in order may store; an ask without a time is
    no hit and stores nothing. A key's times are walked through in one task where
    they are few; those of a frequent key are split by time and reached by jumps.
    """
    micros = ttl_hours * 3_600_000_000
    keyed = df.withColumn("cache_key", F.sha2(key, 256)).withColumn("_ts", F.unix_micros(F.col(ts).cast("timestamp")))
    asks = keyed.where("_ts IS NOT NULL").select("cache_key", "_ts").distinct()
    sizes = cut(asks.groupBy("cache_key").agg(F.count("*").alias("_n")))
    few = asks.join(sizes.where(F.col("_n") <= walked).select("cache_key"), "cache_key", "left_semi")
    lists = few.groupBy("cache_key").agg(F.collect_list("_ts").alias("times"))
    stores = map_batches(lists, _Walk(micros), "cache_key string, _ts bigint, _new boolean").where("_new")
    if not sizes.where(F.col("_n") > walked).isEmpty():
        many = asks.join(sizes.where(F.col("_n") > walked).select("cache_key"), "cache_key", "left_semi")
        stores = stores.unionByName(_jumped(many, micros))
    first = keyed.where("_ts IS NOT NULL").groupBy("cache_key", "_ts").agg(F.min(F.struct(*order)).alias("_who")).join(stores, ["cache_key", "_ts"])
    marked = keyed.join(first, ["cache_key", "_ts"], "left")
    stored = F.coalesce(F.col("_new") & F.struct(*order).eqNullSafe(F.col("_who")), F.lit(False))
    return marked.withColumn("hit", F.col("_ts").isNotNull() & ~stored).drop("_ts", "_new", "_who")


def kept_in_cache(df: DataFrame, key: str, ts: str, size: int = 256) -> DataFrame:
    """The keys used last, as a cache of that size holds them; a limit that is the feature."""
    used = df.groupBy(key).agg(F.max(ts).alias("last_used"), F.count("*").alias("n_uses"))
    return used.orderBy(F.desc("last_used"), key).limit(size)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) for rows that came, went or changed between two snapshots."""
    o = old.select(key, F.struct(*columns).alias("_o"))
    n = new.select(key, F.struct(*columns).alias("_n"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")
