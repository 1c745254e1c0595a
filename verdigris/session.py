"""Session settings and the two helpers that every operator shares.

``session`` builds a session for tests and benches; on a cluster the caller
brings their own. ``cut`` breaks lineage through a reliable checkpoint in the
folder the cluster names. ``spread`` gives Python stages enough partitions when
a table arrives as a single small file.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that go to a Python worker at once; texts may be long.
BATCH_ROWS = 1000


def session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("verdigris")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local(spark: SparkSession) -> bool:
    """Whether driver and executors share one machine's disk."""
    return spark.conf.get("spark.master", "").startswith("local")


def lasting_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, where tables outlive the session; a temporary folder only in a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or _shared_folder(spark)


def _shared_folder(spark: SparkSession) -> str:
    """The session's own part of ``spark.checkpoint.dir``; a temporary folder only in a local session without one, as in tests."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not _local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="verdigris-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Break the lineage with ``checkpoint()`` in the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The frame as a parquet table in the shared folder: for large intermediates, which encode far smaller than rows.

    Like a checkpoint it survives lost executors; columns that a later step
    doesn't need aren't read. The table stays until the folder is cleared.
    """
    path = f"{_shared_folder(df.sparkSession)}/verdigris-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Steps of a plan whose output is partitioned by its own shuffle; asking for the number would run it.
_SHUFFLED = re.compile(r"\b(?:Join|Aggregate|Window|Repartition\w*|Sort|Distinct|Deduplicate|GlobalLimit|RebalancePartitions)\b")


def spread(df: DataFrame) -> DataFrame:
    """Repartition only if a plain scan has fewer partitions than there are cores.

    A large table is already split by its files and passes without a shuffle, as
    does everything that comes out of one.
    """
    if _SHUFFLED.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over bounded batches. ``function`` takes and returns a dict of lists."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spread(df).mapInArrow(_Batches(function, schema), schema)


class _Batches:
    """Arrow batches to dicts of lists and back; picklable."""

    def __init__(self, function, schema: str):
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        self.function = function
        self.schema = to_arrow_schema(StructType.fromDDL(schema))

    def __call__(self, batches):
        import pyarrow as pa

        for batch in batches:
            out = self.function(batch.to_pydict())
            arrays = [pa.array(out[f.name], type=f.type) for f in self.schema]
            whole = pa.RecordBatch.from_arrays(arrays, names=self.schema.names)
            for start in range(0, max(1, whole.num_rows), 10_000):
                yield whole.slice(start, 10_000)
