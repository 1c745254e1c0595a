"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import sentences
from verdigris.sources.tables import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_starts(table(spark, folder, "documents", "doc_id", "text"))


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences per document; documents without text have 0."""
    counted = p8_found(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n_sentences"))
    return table(spark, folder, "documents", "doc_id").join(counted, "doc_id", "left").na.fill(0, ["n_sentences"])


def queries() -> dict:
    return {"p8_found": p8_found, "p8_counts": p8_counts}


def oracle_sql() -> dict:
    return {}
