"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import leak
from verdigris.sources.tables import table


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "heldout_items", "item_id", "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaks(*_tables(spark, folder)).select("doc_id", "item_id")


def p6_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document holds which item, and how much of it."""
    return leak.spans(*_tables(spark, folder)).drop("text_hash")


def p6_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the spans of held-out items."""
    documents, items = _tables(spark, folder)
    return leak.cleaned(documents, leak.spans(documents, items))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every held-out item with the number of documents it leaked into, 0 for none; null for one too short to be told."""
    documents, items = _tables(spark, folder)
    counted = leak.leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n"))
    sizes = leak.item_words(items).select("item_id", "n_words")
    told = F.when(F.col("n_words") >= leak.WORDS, F.coalesce("n", F.lit(0)))
    return table(spark, folder, "heldout_items", "item_id", "split").join(sizes, "item_id").join(counted, "item_id", "left").select("item_id", "split", "n_words", told.alias("n_documents"))


def queries() -> dict:
    return {"p6_found": p6_found, "p6_items": p6_items, "p6_spans": p6_spans, "p6_cleaned": p6_cleaned}


def oracle_sql() -> dict:
    return {}
