"""Queries of problem 1: nested records as flat related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.money import amount_vnd
from verdigris.operators import nested
from verdigris.session import cut
from verdigris.sources.tables import table

HIT, SOURCE, ISSUE = "retrieved_top_k[].chunk_id", "expected_evidence[].doc_id", "issues[]"
SALARY, PERIOD = "preceding_salary", "salary_periods[]"


def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and expected sources with their place, each in its issue; one pass, no shuffle.

    A member stands one level below its array element, whose place it inherits.
    """
    raw = table(spark, folder, "phase5b_failed_queries_diagnostics", "raw_id", "payload")
    return nested.interval_nodes(raw, "raw_id", "payload", [HIT, SOURCE, ISSUE], within=ISSUE)


def salaries(spark: SparkSession, folder: str) -> DataFrame:
    bench = table(spark, folder, "wave2_calculator_benchmark", "bench_row_id", "facts")
    return nested.interval_nodes(bench, "bench_row_id", "facts", [SALARY, PERIOD], within=PERIOD)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    ids = (
        diagnostics(spark, folder)
        .where(F.col("node_type").isin(HIT, SOURCE) & F.col("value").isNotNull())
        .select(
            F.regexp_replace("node_type", r"\[\]", "").alias("field"),
            F.col("record_id").alias("row_id"),
            F.coalesce("parent_pos", F.lit(0)).alias("parent_pos"),
            "pos",
            "value",
        )
    )
    pay = (
        salaries(spark, folder)
        .where(F.col("node_type") == SALARY)
        .select(
            F.lit("facts.preceding_salary").alias("field"),
            F.col("record_id").alias("row_id"),
            F.coalesce("parent_pos", F.lit(0)).alias("parent_pos"),
            F.lit(1).alias("pos"),
            amount_vnd(F.col("kind"), F.col("value")).alias("value"),
        )
        .where(F.col("value").isNotNull())
    )
    return ids.unionByName(pay)


def p1_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The flat tables, linked: every issue, hit, expected source, period and salary with its interval and its parent's key.

    (source, record_id, pre) is the key of a row, (source, record_id, parent_pre)
    that of the row it belongs to.
    """
    raw = table(spark, folder, "phase5b_failed_queries_diagnostics", "raw_id", "payload")
    bench = table(spark, folder, "wave2_calculator_benchmark", "bench_row_id", "facts")
    types = [ISSUE, "retrieved_top_k[]", "expected_evidence[]", HIT, SOURCE]
    a = nested.interval_nodes(raw, "raw_id", "payload", types).withColumn("source", F.lit("payload"))
    b = nested.interval_nodes(bench, "bench_row_id", "facts", [PERIOD, SALARY]).withColumn("source", F.lit("facts"))
    return a.unionByName(b)


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each table belong to a row of which, found once more by containment of the written intervals."""
    nodes = cut(p1_nodes(spark, folder))
    keys = ["source", "record_id"]
    a = nodes.select(*keys, F.col("pre").alias("a_pre"), F.col("post").alias("a_post"), F.col("node_type").alias("a_type"))
    inside = nodes.join(a, keys).where("pre > a_pre AND pre <= a_post")
    found = inside.groupBy(*keys, "pre").agg(F.max_by("a_type", "a_pre").alias("a_type"), F.max("a_pre").alias("a_pre"))
    both = nodes.join(found, [*keys, "pre"], "left")
    return both.groupBy("source", "node_type", "parent_type").agg(F.count("*").alias("n"), F.count_if(F.col("parent_pre").eqNullSafe(F.col("a_pre"))).alias("n_contained"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_nodes": p1_nodes, "p1_links": p1_links}


def oracle_sql() -> dict:
    return {}
