"""Records for tuning and tests: builds, splits, merges, patches, checks (L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.metrics import ordered_values


def chat_record(question: Column, answer: Column, system: str, source: Column | None = None) -> Column:
    """A chat record as JSON; the source is appended to the answer unless it names it already."""
    said = answer
    if source is not None:
        said = F.when(source.isNotNull() & ~F.contains(answer, source), F.concat(answer, F.lit("\n\nNguồn: "), source)).otherwise(answer)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.struct(F.array(turn("system", F.lit(system)), turn("user", question), turn("assistant", said)).alias("messages")))


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only; any engine can compute it."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: val for about the share of keys, else train. Equal keys fall together; no sort, no shuffle."""
    return df.withColumn("split", F.when(hash_share(F.col(key), seed) < share, "val").otherwise("train"))


def split_exact(df: DataFrame, key: str, share: float = 0.1, least: int = 80, seed: int = 42) -> DataFrame:
    """Adds ``split`` with an exact number of keys for val: the share, at least ``least``, at most a fifth.

    Keys stand in the order of their hash share; the last share that is val is
    found by counting, so nothing is sorted as a whole. A null key is train.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.lit(1).alias("one"), F.col(key).alias("k")).distinct().withColumn("share", hash_share(F.col("k"), seed))
    n_val = lambda n: F.least(F.greatest(F.lit(least), F.floor(n * share)), F.floor(n / 5))
    last = ordered_values(keys, "one", "share", {"last": lambda n: n_val(n) - 1}).select(F.when(n_val(F.col("_n")) > 0, F.col("last")).otherwise(-1.0).alias("last"))
    bound = F.coalesce(last.scalar(), F.lit(-1.0))
    return df.withColumn("split", F.when(hash_share(F.col(key), seed) <= bound, "val").otherwise("train"))


def merged(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """The base with those extra rows whose key it lacks."""
    return base.unionByName(extra.join(base.select(key), key, "left_anti"))


def sub_questions(df: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """(key, part_no, part): the whole text as part 0, and its questions long enough to stand alone."""
    parts = F.filter(F.transform(F.split(F.col(text), r"[?\n]"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    several = F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.concat(F.array(F.trim(F.col(text))), several)).alias("part_no", "part"))


def patched(df: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of the patch where it has one."""
    p = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    return df.join(p, key, "left").withColumns({c: F.coalesce(f"_p_{c}", c) for c in columns}).drop(*[f"_p_{c}" for c in columns])


def chat_errors(record: Column) -> Column:
    """What is wrong with a chat record, as a list of words."""
    schema = "struct<messages:array<struct<role:string,content:string>>>"
    parsed = F.from_json(record, schema)["messages"]
    has = lambda role: F.exists(parsed, lambda m: m["role"] == role)
    return F.array_compact(
        F.array(
            F.when(parsed.isNull(), "unreadable"),
            F.when(parsed.isNotNull() & ~F.coalesce(has("user"), F.lit(False)), "no_user"),
            F.when(parsed.isNotNull() & ~F.coalesce(has("assistant"), F.lit(False)), "no_assistant"),
            F.when(F.exists(parsed, lambda m: F.coalesce(F.trim(m["content"]) == "", F.lit(True))), "empty_content"),
        )
    )
