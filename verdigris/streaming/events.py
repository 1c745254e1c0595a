"""Structured Streaming over event tables: windows, sessions, dedup, state, upserts.

Every function takes a streaming (or batch) frame and returns one; sinks are the
caller's, except ``upsert_sink``, which keeps a table of last rows. State is
bounded by the watermark: what arrives later than ``late`` is dropped, as the
API defines it, and nothing else is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, in the order the files came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(df: DataFrame, ts: str, size: str, keys: list[str], late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts per window and keys; tumbling, or sliding with ``slide``."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    counted = df.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n")


def sessionized(df: DataFrame, ts: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    """Sessions of a key, closed by a gap."""
    grouped = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def running_facts(df: DataFrame, key: str, fact: str, value: str) -> DataFrame:
    """(key, facts): all facts of a key, the last value each, after every batch that touches it."""
    schema = f"{key} string, facts map<string,string>"

    def update(group, frames, state):
        known = dict(state.get[0]) if state.exists else {}
        for frame in frames:
            for name, said in zip(frame[fact], frame[value]):
                if said is not None:
                    known[name] = said
        state.update((known,))
        import pandas as pd

        yield pd.DataFrame({key: [group[0]], "facts": [known]})

    grouped = df.select(F.col(key).cast("string").alias(key), fact, value).groupBy(key)
    return grouped.applyInPandasWithState(update, schema, "facts map<string,string>", "update", "NoTimeout")


def upsert_sink(path: str, keys: list[str], order: list[str]):
    """A ``foreachBatch`` function that keeps the last row per key in a table.

    A batch makes a new generation beside the old one and then names it in a
    pointer file, so a reader or a restart never sees half a write. A batch that
    is delivered again makes the same generation again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path)
        both = batch if old is None else old.unionByName(batch)
        rows = F.struct(*[F.col(c) for c in batch.columns])
        kept = both.groupBy(*keys).agg(F.max_by(rows, F.struct(*order)).alias("_r")).select("_r.*")
        kept.write.mode("overwrite").parquet(f"{path}/generation={batch_id}")
        spark.createDataFrame([(batch_id,)], "generation bigint").coalesce(1).write.mode("append").json(f"{path}/pointer")

    return write


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the last named generation has it, or None before the first."""
    try:
        newest = spark.read.schema("generation bigint").json(f"{path}/pointer").agg(F.max("generation")).first()[0]
    except AnalysisException:
        return None
    return spark.read.parquet(f"{path}/generation={newest}")
