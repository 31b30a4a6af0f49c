"""Table, report, snapshot and log sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignals.sources.keyed_table import KeyedTable


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite",
                fmt: str = "parquet") -> None:
    """Write a result table (Parquet by default), optionally partitioned
    so later reads prune partitions."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_report(spark: SparkSession, report: dict, path: str) -> DataFrame:
    """A training report as one JSON row (nested values as JSON text)."""
    flat = {k: (json.dumps(v) if isinstance(v, (dict, list)) else v) for k, v in report.items()}
    df = spark.createDataFrame([flat])
    df.coalesce(1).write.mode("overwrite").json(path)
    return df


def upsert_latest(path: str, key: list[str] | str, order: list[str], **options):
    """``foreachBatch`` sink keeping the latest row per key in a
    ``KeyedTable`` (its ``options``: buckets, ttl_seconds, time_col)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, key, order, **options).upsert(batch, batch_id)

    return run


def read_latest(spark: SparkSession, path: str, keys: DataFrame | None = None, as_of=None) -> DataFrame | None:
    """The latest row per key under ``path`` (None before the first batch), of
    ``keys`` only where given. A snapshot that a batch job wrote whole as
    ``v=<n>`` is read as well: the highest ``n``."""
    table = KeyedTable(spark, path)
    if table.versions():
        return table.read(keys, as_of)
    whole = sorted(int(n[2:]) for n in table.files.names(path) if n.startswith("v=") and "_SUCCESS" in table.files.names(f"{path}/{n}"))
    return spark.read.parquet(f"{path}/v={whole[-1]}") if whole else None


def log_prices(df: DataFrame, path: str, ts_col: str = "timestamp", batch_id: int | None = None) -> None:
    """Append pricing decisions, partitioned by date. With ``batch_id`` (a
    micro-batch) they go to the batch's own partitions of each date, which a
    retry of the batch writes over, so that no decision is logged twice."""
    dated = df.withColumn("date", F.to_date(F.col(ts_col)))
    if batch_id is None:
        dated.write.mode("append").partitionBy("date").parquet(path)
    else:
        (dated.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date", "batch_id").parquet(path))
