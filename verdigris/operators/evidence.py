"""Scoring, choosing and packing of evidence per issue (E).

An issue is any group of candidate rows; every order ends with the row's key.
Rules are small tables that the caller passes, never branches here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_signal(issue: str, score: str, key: str) -> Column:
    """1 - rank / total inside the issue, rank from 0."""
    w = Window.partitionBy(issue)
    rank = F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), key)) - 1
    return 1 - rank / F.count("*").over(w)


def weighted(signals: dict[str, tuple[Column, float]]) -> Column:
    """Sum of the signals by their weights; a null signal counts 0."""
    total = F.lit(0.0)
    for signal, weight in signals.values():
        total = total + F.coalesce(signal, F.lit(0.0)) * weight
    return total


def sibling_bonus(df: DataFrame, issue: str, siblings: list[str], score: str, key: str, bonus: float = 1.0) -> DataFrame:
    """The best of several siblings (same issue and provision) gets the bonus, if its score is above 0."""
    w = Window.partitionBy(issue, *siblings)
    first = F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), key)) == 1
    return df.withColumn("bonus", F.when(first & (F.count("*").over(w) > 1) & (F.col(score) > 0), F.lit(bonus)).otherwise(F.lit(0.0)))


def winners(df: DataFrame, issue: str, score: str, key: str, least: float = 0.5, margin: float = 0.1) -> DataFrame:
    """Per issue the best row, the runner-up's score, the margin, and whether the choice is unclear."""
    w = Window.partitionBy(issue).orderBy(F.col(score).desc_nulls_last(), key)
    ranked = df.withColumn("_n", F.row_number().over(w)).withColumn("second_score", F.lead(score).over(w)).where("_n = 1")
    gap = F.col(score) - F.coalesce(F.col("second_score"), F.lit(0.0))
    return ranked.select(
        issue,
        F.col(key).alias("winner"),
        F.col(score).alias("best_score"),
        "second_score",
        F.round(gap, 6).alias("margin"),
        (F.coalesce(F.col(score) < least, F.lit(True)) | (F.round(gap, 6) < margin)).alias("unclear"),
    )


def role_cover(df: DataFrame, issue: str, roles: str, score: str, key: str) -> DataFrame:
    """Per issue and role the best row with a positive score that holds it."""
    held = df.where(F.col(score) > 0).select(issue, key, score, F.explode(F.array_distinct(roles)).alias("role"))
    return held.groupBy(issue, "role").agg(F.min_by(F.struct(F.col(key), F.col(score)), F.struct(-F.col(score), F.col(key))).alias("_b")).select(
        issue, "role", F.col(f"_b.{key}").alias(key), F.col(f"_b.{score}").alias(score)
    )


def capped(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each group, in the order; that is the feature, not a shortcut."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most)


def fair_share(df: DataFrame, owner: str, issue: str, order: list[Column], key: str) -> DataFrame:
    """Round robin over the issues of an owner: first of each issue, second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(owner, issue).orderBy(*order))
    w = Window.partitionBy(owner).orderBy("turn", issue, key)
    return df.withColumn("turn", turn).withColumn("position", F.row_number().over(w))


def within_budget(df: DataFrame, owner: str, position: str, size: Column, budget: int, separator: int = 42, free: int = 2) -> DataFrame:
    """The longest prefix whose sizes fit the budget; the first ``free`` rows always stay."""
    w = Window.partitionBy(owner).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(size + separator).over(w)
    over = (spent > budget) & (F.col(position) > free)
    breach = F.min(F.when(F.col("_over"), F.col(position))).over(Window.partitionBy(owner))
    return (
        df.withColumn("spent", spent)
        .withColumn("_over", over)
        .withColumn("_breach", breach)
        .where(F.col("_breach").isNull() | (F.col(position) < F.col("_breach")))
        .drop("_over", "_breach")
    )


def completeness(df: DataFrame, issue: str, roles: str, required: list[str]) -> DataFrame:
    """Share of the required roles that an issue's rows cover, and the verdict."""
    covered = F.lit(0)
    for role in required:
        covered = covered + F.max(F.coalesce(F.array_contains(roles, role), F.lit(False)).cast("int"))
    out = df.groupBy(issue).agg(covered.cast("int").alias("n_covered"), F.count("*").alias("n_rows"))
    ratio = F.round(F.col("n_covered") / len(required), 6)
    verdict = F.when(ratio == 1, "PASS").when(ratio >= 0.5, "PARTIAL").when(ratio > 0, "INCOMPLETE").otherwise("FAIL")
    return out.select(issue, "n_rows", "n_covered", ratio.alias("ratio"), verdict.alias("verdict"))


def plan_constraints(texts: DataFrame, key: str, text: str, rules: list[dict]) -> DataFrame:
    """Rules whose every group of alternatives is found and none of whose exclusions is, one row per text and rule.

    A rule is a dict of name, priority, all (a list of lists of words) and none
    (a list of words). The rules are a constant array, so the texts aren't
    joined with anything.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    fired = []
    for rule in rules:
        hit = F.lit(bool(rule["all"]))
        for group in rule["all"]:
            any_of = F.lit(False)
            for word in group:
                any_of = any_of | F.contains(low, F.lit(word))
            hit = hit & any_of
        for word in rule.get("none", []):
            hit = hit & ~F.contains(low, F.lit(word))
        fired.append(F.when(hit, F.struct(F.lit(rule["priority"]).alias("priority"), F.lit(rule["name"]).alias("rule"))))
    return texts.select(key, F.posexplode(F.array_sort(F.array_compact(F.array(*fired)))).alias("pos", "_r")).select(
        key, (F.col("pos") + 1).cast("int").alias("place"), "_r.rule", "_r.priority"
    )
