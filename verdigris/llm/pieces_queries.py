"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import pieces
from verdigris.sources.tables import table


#: What says where a content stands; its pieces keep it.
PLACE = ("article_number", "clause_number", "point")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scored_evidence").select(
        F.col("evidence_row_id").alias("row_id"), F.col("content").alias("text"), *PLACE
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """A row with more than one piece was over the limit; its first piece stands for it."""
    return (
        pieces.long_pieces(_texts(spark, folder))
        .where("piece_no = 1")
        .select(
            F.col("row_id").alias("evidence_row_id"),
            F.when(F.col("unbroken"), "unbroken").otherwise("plain").alias("kind"),
        )
    )


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of all evidence, with the article, clause and point that they belong to."""
    return pieces.all_pieces(_texts(spark, folder), keep=PLACE).withColumnRenamed("row_id", "evidence_row_id")


def p5_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each content put together again: covers, limit and overlap."""
    return pieces.rejoined(pieces.all_pieces(_texts(spark, folder))).drop("n_pieces").withColumnRenamed("row_id", "evidence_row_id")


def queries() -> dict:
    return {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rejoined": p5_rejoined}


def oracle_sql() -> dict:
    return {
        "p5_found": """
SELECT evidence_row_id,
       CASE WHEN regexp_matches(content, '[^\\s\\x{85}\\p{Z}]{1000}[^\\s\\x{85}\\p{Z}]{201}')
            THEN 'unbroken' ELSE 'plain' END AS kind
FROM scored_evidence
WHERE length(content) > 1200""",
        "p5_rejoined": """
SELECT evidence_row_id, true AS within_limit, true AS overlap_kept, md5(content) AS content_hash
FROM scored_evidence
WHERE content IS NOT NULL""",
    }
