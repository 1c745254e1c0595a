"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import defects
from verdigris.sources.tables import table


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "turns").select(
        F.lit("turns").alias("pair_table"),
        F.col("turn_row_id").alias("row_id"),
        F.col("user_query").alias("question"),
        F.col("assistant_response").alias("answer"),
        F.lit(None).cast("boolean").alias("abstain"),
    )
    cases = table(spark, folder, "phase5_7_cases_results").select(
        F.lit("phase5_7_cases_results").alias("pair_table"),
        F.col("case_row_id").alias("row_id"),
        F.col("query").alias("question"),
        F.col("full_answer").alias("answer"),
        "abstain",
    )
    return turns.unionByName(cases)


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with its defect, null where it is sound, and whether its abstain flag says otherwise than its text."""
    languages = defects.fit_languages(table(spark, folder, "documents", "doc_id", "lang", "text"))
    declines = F.coalesce(F.col("defect") == "REFUSAL", F.lit(False))
    return defects.judged(pairs(spark, folder), languages).withColumn("abstain_differs", F.col("abstain") != declines)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pairs(spark, folder).where("defect is not null").select("pair_table", "row_id", "defect")


def queries() -> dict:
    return {"p4_found": p4_found, "p4_pairs": p4_pairs}


def oracle_sql() -> dict:
    return {}
