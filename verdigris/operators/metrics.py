"""Scores of rankings and answers, and their aggregates (M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def relevant(document: str, article: str, gold_document: str, gold_article: str) -> Column:
    """A chunk of the expected document and, where one is expected, of its article. Never null."""
    same_article = F.col(gold_article).isNull() | (F.trim(F.col(article)).try_cast("int") == F.col(gold_article))
    return F.coalesce((F.col(document) == F.col(gold_document)) & same_article, F.lit(False))


def per_query(gold: DataFrame, ranked: DataFrame, scorable: Column) -> DataFrame:
    """Gold rows with the first relevant rank; null if none was found."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"))
    return gold.withColumn("scorable", scorable).join(first, "query", "left")


def by_type(scores: DataFrame, kind: str) -> DataFrame:
    """Means per kind and over all, in one pass; only scorable queries enter the means."""
    # Grouping sets over no row give no total row, unlike a plain total; both are left empty here.
    mean = lambda c: F.round(F.avg(F.when(F.col("scorable"), c)), 6)
    hits = [mean(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double")).alias(f"hit_{k}") for k in (1, 3, 5, 10)]
    grouped = scores.groupingSets([[F.col(kind)], []], F.col(kind)).agg(
        F.count("*").alias("n"),
        F.count_if("scorable").alias("n_scorable"),
        *hits,
        mean(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))).alias("mrr"),
        F.grouping(kind).alias("_all"),
    )
    return grouped.withColumn(kind, F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col(kind))).drop("_all")


def recall_by(gold: DataFrame, held: DataFrame, kind: str) -> DataFrame:
    """(kind, n, recall_5, recall_10, chunk_recall_5, chunk_recall_10): mean shares of each query's gold that its ranking holds.

    ``gold`` has (query, kind, gold array of chunk ids), ``held`` (query, rank,
    chunk_id). A chunk is held if it or a part of it (its id with ``-`` and more)
    is ranked; an article, told by the id up to its number, if any chunk of it is.
    """
    article = lambda c: F.regexp_extract(c, r"^[^#]+#d\d+", 0)
    mine = lambda k: F.coalesce(F.collect_list(F.when(F.col("rank") <= k, F.col("chunk_id"))), F.array().cast("array<string>"))
    tops = held.groupBy("query").agg(mine(5).alias("top_5"), mine(10).alias("top_10"))
    both = gold.join(tops, "query", "left")

    def top(k):
        return F.coalesce(F.col(f"top_{k}"), F.array().cast("array<string>"))

    def of_articles(k):
        articles = F.array_distinct(F.transform("gold", article))
        found = F.filter(articles, lambda a: (a != "") & F.exists(top(k), lambda c: article(c) == a))
        return F.round(F.avg(F.size(found) / F.size(articles)), 6).alias(f"recall_{k}")

    def of_chunks(k):
        found = F.filter("gold", lambda g: F.exists(top(k), lambda c: (c == g) | c.startswith(F.concat(g, F.lit("-")))))
        return F.round(F.avg(F.size(found) / F.size("gold")), 6).alias(f"chunk_recall_{k}")

    out = [F.count("*").alias("n"), of_articles(5), of_articles(10), of_chunks(5), of_chunks(10)]
    return both.groupBy(kind).agg(*out)


def ordered_values(df: DataFrame, group: str, value: str, places: dict, buckets: int = 1024) -> DataFrame:
    """(group, _n, a column for each place): values at places of the group's sorted values, counted from 0.

    ``places`` gives for each name a function of the group's number of values.
    Values are counted in equal ranges between the group's least and greatest;
    only the ranges that hold a place are sorted. Groups of any size combine
    map-side, and no list of values is collected. Nulls don't count; a group
    without values has no row, one whose key is null has one. Places outside
    are moved to the nearest end.
    """
    v = df.where(F.col(value).isNotNull()).select(F.struct(F.col(group)).alias("_g"), F.col(value).cast("double").alias("_v"))
    ends = v.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    width = F.greatest((F.col("_high") - F.col("_low")) / buckets, F.lit(1e-300))
    binned = v.join(ends, "_g").withColumn("_bin", F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(buckets - 1)))
    counts = binned.groupBy("_g", "_bin", "_n").agg(F.count("*").alias("_k"))
    w = Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda place: F.greatest(F.least(place(F.col("_n")), F.col("_n") - 1), F.lit(0)).cast("bigint")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), inside(place).alias("at")) for name, place in places.items()]))
    placed = counts.withColumn("_before", F.coalesce(F.sum("_k").over(w), F.lit(0))).withColumn("_p", wanted)
    found = placed.where((F.col("_before") <= F.col("_p.at")) & (F.col("_p.at") < F.col("_before") + F.col("_k"))).select(
        "_g", "_bin", F.col("_p.name").alias("_name"), (F.col("_p.at") - F.col("_before") + 1).alias("_nth")
    )
    held = binned.join(found, ["_g", "_bin"])
    nth = F.row_number().over(Window.partitionBy("_g", "_bin", "_name").orderBy("_v"))
    picked = held.withColumn("_r", nth).where("_r = _nth")
    out = picked.groupBy("_g", "_n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])
    return out.select(F.col("_g")[group].alias(group), "_n", *places)


def order_statistic(df: DataFrame, group: str, value: str, share: float, out: str, buckets: int = 1024) -> DataFrame:
    """(group, out): the value at place floor(n * share) of the group's sorted values, as ``ordered_values`` finds it."""
    return ordered_values(df, group, value, {out: lambda n: F.floor(n * share)}, buckets).drop("_n")


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): percentiles between the two nearest values, exact for groups of any size."""
    places: dict = {}
    for name, share in shares.items():
        places[f"_{name}_a"] = lambda n, share=share: F.floor((n - 1) * share)
        places[f"_{name}_b"] = lambda n, share=share: F.ceil((n - 1) * share)
    found = ordered_values(df, group, value, places)

    def between(name, share):
        at = (F.col("_n") - 1) * share
        return F.col(f"_{name}_a") + (F.col(f"_{name}_b") - F.col(f"_{name}_a")) * (at - F.floor(at))

    return found.select(group, *[between(name, share).alias(name) for name, share in shares.items()])
