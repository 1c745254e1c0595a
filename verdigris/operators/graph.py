"""References mined from texts, and steps over the edges they make (G).

An edge table has (src, dst, relation). Nodes are whatever names the caller
uses; here document numbers and numbered provisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How statutes are numbered in the texts.
NUMBER = r"(\d{1,4}(?:/\d{4})?/[0-9A-ZĐ]+(?:-[A-ZĐ]+)?)"


def mined(df: DataFrame, source: str, text: str) -> DataFrame:
    """(src, dst, n_mentions): distinct references of a source's texts to document numbers, self-loops left out."""
    found = df.select(F.col(source).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(NUMBER), F.lit(1))).alias("dst"))
    return found.where("src IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n_mentions"))


def known_only(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges whose target is a known node."""
    return edges.join(nodes.select(F.col(node).alias("dst")).distinct(), "dst", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def step(seeds: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """(seed, node): neighbours of the seeds; out, in, or both ways, distinct."""
    forward = edges.select(F.col("src").alias("seed"), F.col("dst").alias("node"))
    back = edges.select(F.col("dst").alias("seed"), F.col("src").alias("node"))
    ways = {"out": forward, "in": back, "both": forward.unionByName(back)}[direction]
    return seeds.select("seed").distinct().join(ways, "seed").where("seed <> node").distinct()


def two_branches(nodes: DataFrame, node: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """(node, branch, src, n_branch): per node its distinct incoming sources over two kinds of edge, one row each, and their number.

    A node without any has one row without a source. Nothing is collected, so a
    node that everything names is as many rows as it has sources.
    """
    sides = [e.select(F.col("dst").alias(node), F.lit(name).alias("branch"), "src").distinct() for e, name in ((first, "guides"), (second, "penalties"))]
    both = sides[0].unionByName(sides[1])
    counts = both.groupBy(node, "branch").agg(F.count("*").alias("n_branch"))
    return nodes.select(node).distinct().join(both.join(counts, [node, "branch"]), node, "left").na.fill(0, ["n_branch"])


def expand_ranking(ranked: DataFrame, node: str, edges: DataFrame, members: DataFrame, decay: float = 0.9, per_node: int = 3, most: int = 6) -> DataFrame:
    """Chunks of neighbouring nodes join a ranking at their seed's score times the decay.

    ``ranked`` has (query, key, score, node) and ``members`` (key, node); a chunk
    already ranked isn't added, at most ``per_node`` come from one node and
    ``most`` in all. Of each node only so many members are joined as can be
    wanted: ``per_node``, and as many more as the longest ranking may hold.
    """
    seeds = ranked.groupBy("query", F.col(node).alias("seed")).agg(F.max("score").alias("seed_score"))
    near = step(seeds, edges, "both")
    reached = seeds.join(near, "seed").groupBy("query", F.col("node").alias(node)).agg(F.max("seed_score").alias("seed_score"))
    longest = ranked.groupBy("query").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    first = members.withColumn("_m", F.row_number().over(Window.partitionBy(node).orderBy("key"))).where(F.col("_m") <= per_node + longest).drop("_m")
    new = reached.join(first, node).join(ranked.select("query", "key"), ["query", "key"], "left_anti")
    inside = Window.partitionBy("query", node).orderBy("key")
    overall = Window.partitionBy("query").orderBy(F.col("seed_score").desc(), node, "key")
    few = new.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= per_node)
    return few.withColumn("place", F.row_number().over(overall)).where(F.col("place") <= most).select(
        "query", "key", node, "place", F.round(F.col("seed_score").cast("double") * decay, 6).alias("score")
    )
