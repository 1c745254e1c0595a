"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import mixture
from verdigris.sources.tables import table


def _plan(spark: SparkSession, folder: str) -> mixture.Plan:
    """The tokenizer's folder is ``spark.verdigris.tokenizers``, where set."""
    vocabulary = f"{spark.conf.get('spark.verdigris.tokenizers', mixture.TOKENIZERS)}/byte_bpe_multi_50k.tiktoken"
    return mixture.Plan(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"), tokenizer=vocabulary)


def p7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its source, size and repeat count."""
    return _plan(spark, folder).repeats().select("doc_id", "source", "n_tokens", "repeats")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share reached per source."""
    return _plan(spark, folder).shares()


def p7_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture itself, slot by slot."""
    return _plan(spark, folder).schedule()


def queries() -> dict:
    return {"p7_repeats": p7_repeats, "p7_shares": p7_shares, "p7_schedule": p7_schedule}


def oracle_sql() -> dict:
    return {}
