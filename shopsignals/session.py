"""Session construction and cluster-safe helpers.

``get_spark`` only fills in settings that are not already set, so a cluster's
own configuration (shuffle partitions, checkpoint dir, memory) always wins.
"""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Applied with setIfMissing semantics.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partial aggregation stays on for hot keys; AQE splits skewed join
    # partitions and coalesces tiny ones.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "shopsignals",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, creating a local one if none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    ``spark.checkpoint.dir`` where the cluster names one; where it is unset, a
    folder beside the warehouse, which is shared as well. Never a machine's own
    temporary folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_marked: set[str] = set()


def tables_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables in the shared folder;
    it is deleted when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/shopsignals-{spark.sparkContext.applicationId}"
    if path not in _marked:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(path)
    return path


def input_state(df: DataFrame) -> tuple:
    """(file, bytes, time of change) of all files that ``df`` reads."""
    sc, out = df.sparkSession.sparkContext, []
    for name in sorted(df.inputFiles()):
        p = sc._jvm.org.apache.hadoop.fs.Path(name)
        s = p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append((name, s.getLen(), s.getModificationTime()))
    return tuple(out)


@contextmanager
def small_tasks(spark: SparkSession, n_tasks: int):
    """Plans that run inside shuffle into ``n_tasks`` partitions (at least one a
    core), which are not joined together again, and read files in pieces of 16 MB."""
    n = max(n_tasks, spark.sparkContext.defaultParallelism)
    ours = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "16m"}
    before = {k: spark.conf.get(k) for k in ours}
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


TASK_BYTES = 4 << 20  # of the files that a plan reads, for one task


def tasks_for(df: DataFrame) -> int:
    """Tasks for a plan by the bytes of its input files."""
    return math.ceil(sum(size for _, size, _ in input_state(df)) / TASK_BYTES)


def materialize_small(df: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """``materialize`` with as many tasks as the rows need (``small_tasks``; by
    the size of the input files where no number is given): a task's memory stays
    as it is when the tables grow."""
    with small_tasks(df.sparkSession, tasks_for(df) if n_tasks is None else n_tasks):
        return materialize(df)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it as Parquet under the shared folder and read
    it back (a written table cuts the lineage like a reliable checkpoint, but in
    one computation, and gives AQE exact sizes).

    Used where one intermediate feeds both a whole-table scalar (a bound, a
    count, a median) and the rows themselves: without it the scalar
    subquery would re-run the whole upstream plan (e.g. the clickstream
    aggregation) a second time.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
