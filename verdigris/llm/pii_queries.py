"""Queries of problem 3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import pii
from verdigris.sources.tables import table

FIELDS = [
    ("turns", "turn_row_id", "user_query"),
    ("feedback", "feedback_row_id", "comment"),
    ("feedback", "feedback_row_id", "reported_answer"),
]


def texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, name).select(
            F.lit(f"{name}.{column}").alias("field"), F.col(key).alias("row_id"), F.col(column).alias("text")
        )
        for name, key, column in FIELDS
    ]
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.items(texts(spark, folder)).select("field", "row_id", "pii_type", "item_no")


def _key(spark: SparkSession):
    """The secret of the surrogates, ``spark.verdigris.pii.key``; without it each call draws its own."""
    return spark.conf.get("spark.verdigris.pii.key", None)


def p3_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders, and with keyed surrogates that differ where the entities do."""
    return pii.replaced_distinct(texts(spark, folder), _key(spark))


def p3_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Surrogates that more than one entity has in the end; there should be none."""
    return pii.collisions(pii.items(texts(spark, folder)), _key(spark))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_replaced": p3_replaced, "p3_collisions": p3_collisions}


def oracle_sql() -> dict:
    return {}
