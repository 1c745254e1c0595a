"""Queries of problem 2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import lookalike
from verdigris.sources.tables import table

FIELDS = [
    ("phase5b_eval_dataset", "row_id", "question"),
    ("scored_evidence", "evidence_row_id", "content"),
    ("turns", "turn_row_id", "user_query"),
]


def texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, name).select(
            F.lit(f"{name}.{column}").alias("field"), F.col(key).alias("row_id"), F.col(column).alias("text")
        )
        for name, key, column in FIELDS
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.equal_looking_pairs(texts(spark, folder))


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every row's text in its one form."""
    return lookalike.canonical_texts(texts(spark, folder))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that looks like a different spelling, with its class: as many rows as texts, whatever the pairs."""
    return lookalike.classes(texts(spark, folder)).select("field", "row_id", F.hex("class_id").alias("class_id"), F.hex("spelling").alias("spelling"), "n_spellings")


def queries() -> dict:
    return {"p2_found": p2_found, "p2_canonical": p2_canonical, "p2_classes": p2_classes}


def oracle_sql() -> dict:
    return {}
