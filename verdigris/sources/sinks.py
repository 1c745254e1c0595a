"""Tables kept up to date and graphs written (S19, S20): generations beside each other, and a pointer to the newest.

A write makes a whole new generation and then names it, so a reader or a restart
sees the old one until the new one is complete. Defined results: a null key is a
key like any other; of rows with one key the last in order holds, ties keep the
greatest row; a deletion takes back what stood before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.files import publish, published, version_of


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str], deleted: str | None = None) -> None:
    """The table at ``path`` with the new rows in place of those with their keys.

    ``deleted`` names a boolean column that marks rows whose key is to go; it
    isn't kept.
    """
    spark = new.sparkSession
    marked = new.withColumn("_gone", F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False))
    marked = marked.drop(deleted) if deleted else marked
    last = version_of(spark, path)
    both = marked if last is None else marked.unionByName(published(spark, path).withColumn("_gone", F.lit(False)))
    columns = [c for c in both.columns if c != "_gone"]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in columns])
    kept = both.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(F.struct(*columns, "_gone"), packed).alias("_r")).select("_r.*")
    publish(kept.where("NOT _gone").drop("_gone"), path, str(0 if last is None else int(last) + 1))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Nodes by key and edges by (src, dst, relation), each once, merged into the graph at ``path``."""
    upsert(nodes, f"{path}/nodes", [key], order)
    upsert(edges.select("src", "dst", "relation").distinct(), f"{path}/edges", ["src", "dst", "relation"], [])


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return published(spark, f"{path}/nodes"), published(spark, f"{path}/edges")
