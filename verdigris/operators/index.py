"""Lexical index over chunks: postings, statistics, fingerprints, upkeep (X)."""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import tokens
from verdigris.session import lasting_folder, map_batches, spread


#: Chunks that a bucket of terms is sized for.
PER_BUCKET = 100_000
#: Goes up when the packed rows or the tokens change, so that no index of another make is opened.
FORMAT = 2
#: The term under which every chunk with tokens stands; it sorts before all others.
ALL = "\x00"


class _Count:
    """Each row's words counted where they are, since a row never shares a chunk with another."""

    def __call__(self, batch):
        out: dict = {"key": [], "dl": [], "term": [], "tf": []}
        for key, words in zip(batch["key"], batch["words"]):
            counted = Counter(words)
            if counted:
                counted[ALL] = len(words)
            out["key"] += [key] * len(counted)
            out["dl"] += [len(words)] * len(counted)
            out["term"] += counted.keys()
            out["tf"] += counted.values()
        return out


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, term, tf): one row per chunk and term, made without a shuffle; keys are unique numbers.

    Tokens come from the JVM; only counting them is Python's. Chunks without
    tokens have no postings; each other one has a row for ``ALL`` with its length.
    """
    words = chunks.select(F.col(key).cast("bigint").alias("key"), tokens(F.col(text)).alias("words"))
    return map_batches(words, _Count(), "key bigint, dl int, term string, tf bigint")


class _Pack:
    """A batch of chunks as a block of postings, made where the chunks are.

    The row of ``ALL`` has the block's keys and lengths; each term's row has the
    places of its chunks among them and how often it stands there, in one byte
    where that will do. A block's number is its task's and its place in it, the
    same when a lost task is run again.
    """

    def __init__(self):
        self.made = 0

    def __call__(self, batch):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 20 | self.made
        self.made += 1
        held = [(key, words) for key, words in zip(batch["key"], batch["words"]) if words]
        places: dict = {}
        for place, (_, words) in enumerate(held):
            for term, tf in Counter(words).items():
                places.setdefault(term, []).append((place, tf))
        out: dict = {"term": [], "block": [], "n": [], "at": [], "tfs": []}
        if held:
            out["term"].append(ALL)
            out["n"].append(len(held))
            out["at"].append(np.array([key for key, _ in held], np.int64).tobytes())
            out["tfs"].append(np.array([len(words) for _, words in held], np.int32).tobytes())
        for term, found in places.items():
            out["term"].append(term)
            out["n"].append(len(found))
            out["at"].append(array("H", [place for place, _ in found]).tobytes())
            tfs = [tf for _, tf in found]
            out["tfs"].append(bytes(tfs) if max(tfs) < 256 else np.array(tfs, np.uint32).tobytes())
        out["block"] = [block] * len(out["term"])
        return out


def unpacked(n: int, at: bytes, tfs: bytes):
    """Places and counts of a term's row."""
    return np.frombuffer(at, np.uint16), np.frombuffer(tfs, np.uint8 if len(tfs) == n else np.uint32)


PACKED = "term string, block bigint, n int, at binary, tfs binary"


def content_facts(chunks: DataFrame, key: str, text: str) -> str:
    """Number and order-free sums of the chunks' hashes, digested: equal for equal chunks in any order."""
    h = F.xxhash64(F.col(key).cast("bigint"), F.col(text))
    row = chunks.select(h.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"))
    return row.select(F.concat(F.col("n").cast("string"), F.lit("-"), F.sha2(F.concat_ws(":", "n", "s", "x"), 256))).first()[0]


class Index:
    """Packed postings that outlive the query, in buckets of terms.

    The index of a set of chunks is named by their content, so it is built once
    and later opened only while it is valid; a table of facts, written last, says
    that it is whole. Queries read the buckets of their terms alone.
    """

    def __init__(self, chunks: DataFrame, key: str, text: str, folder: str | None = None):
        self.spark = chunks.sparkSession
        self.digest = content_facts(chunks, key, text)
        n = int(self.digest.split("-")[0])
        self.n_buckets = 16 << max(0, (n // PER_BUCKET // 16).bit_length())
        self.path = f"{folder or lasting_folder(self.spark)}/verdigris-index/{FORMAT}-{self.digest}"
        facts = self._facts()
        if facts is None:
            self._build(chunks, key, text)
            facts = self._facts()
        self.n, self.total = facts
        self.avgdl = self.total / self.n if self.n else 0.0

    def _facts(self):
        try:
            row = self.spark.read.schema("n bigint, total bigint").json(f"{self.path}/facts").first()
        except AnalysisException:
            return None
        return None if row is None else (row.n or 0, row.total or 0)

    def _build(self, chunks, key, text):
        words = chunks.select(F.col(key).cast("bigint").alias("key"), tokens(F.col(text)).alias("words"))
        packed = map_batches(words, _Pack(), PACKED).withColumn("bucket", self.bucket("term"))
        spread_out = packed.repartition("bucket").sortWithinPartitions("bucket", "term", "block")
        spread_out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        whole = self.packed.where((F.col("bucket") == self.bucket(F.lit(ALL))) & (F.col("term") == ALL)).select("n", "tfs")
        sums = map_batches(whole, _Sums(), "n bigint, total bigint").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        sums.coalesce(1).write.mode("overwrite").json(f"{self.path}/facts")

    def bucket(self, term) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.n_buckets)).cast("int")

    @property
    def packed(self) -> DataFrame:
        return self.spark.read.schema(f"{PACKED}, bucket int").parquet(f"{self.path}/postings")

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """The packed postings of the terms, and the rows of ``ALL``; only their buckets are read."""
        terms = terms.select("term").distinct().unionByName(self.spark.range(1).select(F.lit(ALL).alias("term")))
        buckets = [row[0] for row in terms.select(self.bucket("term")).distinct().collect()]  # at most n_buckets numbers
        return self.packed.where(F.col("bucket").isin(buckets)).join(terms, "term", "left_semi")

    def term_statistics(self) -> DataFrame:
        """(term, df) of all terms."""
        return self.packed.where(F.col("term") != ALL).groupBy("term").agg(F.sum("n").alias("df"))


class _Sums:
    def __call__(self, batch):
        return {"n": batch["n"], "total": [int(np.frombuffer(t, np.int32).sum(dtype=np.int64)) for t in batch["tfs"]]}


def corpus_statistics(chunks: DataFrame, text: str) -> DataFrame:
    """One row: the number of chunks with tokens and their mean length."""
    sizes = spread(chunks.select(F.col(text).alias("text"))).select(F.size(tokens(F.col("text"))).alias("dl")).where("dl > 0")
    return sizes.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, digest of the columns), null-safe and unambiguous in what belongs to which column."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return df.select(key, F.sha2(F.concat(*parts), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame, key: str, text: str, meta: list[str]) -> DataFrame:
    """Three-way difference of two generations: added, removed, text, metadata or same.

    One full outer join on the key; null-safe comparison.
    """
    o = old.select(F.col(key), F.lit(True).alias("_in_old"), F.col(text).alias("_old_text"), *[F.col(c).alias(f"_old_{c}") for c in meta])
    n = new.select(F.col(key), F.lit(True).alias("_in_new"), F.col(text).alias("_new_text"), *[F.col(c).alias(f"_new_{c}") for c in meta])
    same_meta = F.lit(True)
    for c in meta:
        same_meta = same_meta & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "removed")
        .when(~F.col("_old_text").eqNullSafe(F.col("_new_text")), "text")
        .when(~same_meta, "metadata")
        .otherwise("same")
    )
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by the order's columns; a tie keeps the greatest. Aggregated, not windowed, so hot keys combine map-side."""
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("_row"))
    return packed.select("_row.*")


def apply_changes(old: DataFrame, new: DataFrame, key: str, text: str, meta: list[str]) -> DataFrame:
    """The old generation brought up to the new one by its changes alone: gone rows go, added and changed ones come from the new.

    Rows that are the same are kept from the old, so whatever was made of them
    stays valid; ``kept`` says so.
    """
    what = changes(old, new, key, text, meta)
    columns = [key, text, *meta]
    kept = old.select(*columns).join(what.where("change = 'same'").select(key), key, "left_semi").withColumn("kept", F.lit(True))
    fresh = new.select(*columns).join(what.where("change IN ('added', 'text', 'metadata')").select(key), key, "left_semi").withColumn("kept", F.lit(False))
    return kept.unionByName(fresh)


def validity(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """One row: the counts of both sides and whether an index of the old still holds for the new."""
    facts = lambda df, name: df.select(F.xxhash64(F.col(key), F.col(text)).alias("h")).agg(
        F.count("*").alias(f"n_{name}"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias(f"s_{name}"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias(f"x_{name}")
    )
    sides = facts(old, "old").select(F.struct("*").alias("o"), F.lit(1).alias("one")).join(facts(new, "new").select(F.struct("*").alias("w"), F.lit(1).alias("one")), "one")
    same = (F.col("o.n_old") == F.col("w.n_new")) & (F.col("o.s_old") == F.col("w.s_new")) & (F.col("o.x_old") == F.col("w.x_new"))
    return sides.select("o.n_old", "w.n_new", same.alias("is_valid"))
