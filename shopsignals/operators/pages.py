"""Pages of a stored order, however deep.

The rows are range split in the stated order and written once, each with its
place in its partition; with them goes one count a partition. A page then needs
only the counts and the partitions that hold it, the first page as the
hundred-thousandth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopsignals.session import tables_dir

_PLACE = (1 << 33) - 1  # the low bits of monotonically_increasing_id: the row's place in its partition


def store_order(df: DataFrame, order: list[Column], path: str | None = None) -> str:
    """Write ``df`` in a total order; the path to read pages from (of its own in
    the shared folder, where none is given)."""
    path = path or f"{tables_dir(df.sparkSession)}/order-{uuid.uuid4().hex}"
    rows = (df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
            .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))))
    rows.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/rows")
    counts = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    # one row a partition
    counts.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
          .write.mode("overwrite").parquet(f"{path}/counts")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    return path


def stored_page(spark: SparkSession, path: str, page_no: int = 1, limit: int = 20) -> DataFrame:
    """One page of a stored order, with position, total_rows, total_pages and
    has_more; only the partitions that hold its rows are read."""
    start = (page_no - 1) * limit
    counts = spark.read.schema("_part int, rows long, before long").parquet(f"{path}/counts")
    total = int(counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
    held = counts.where((F.col("before") < start + limit) & (F.col("before") + F.col("rows") > start))
    parts = held.agg(F.collect_list(F.struct("_part", "before"))).first()[0]  # those that the page spans
    columns = spark.read.parquet(f"{path}/columns")
    stored = columns.withColumn("_place", F.lit(0).cast("long")).withColumn("_part", F.lit(0)).schema
    if not parts:
        rows = columns.withColumn("position", F.lit(0).cast("long"))
    else:
        before = F.element_at(F.create_map(*[F.lit(x) for p in parts for x in (int(p["_part"]), int(p["before"]))]), F.col("_part"))
        rows = (spark.read.schema(stored).parquet(f"{path}/rows").where(F.col("_part").isin([int(p["_part"]) for p in parts]))
                .withColumn("position", before + F.col("_place") + 1)
                .where((F.col("position") > start) & (F.col("position") <= start + limit)).select(*columns.columns, "position"))
    return (rows.withColumn("total_rows", F.lit(total)).withColumn("total_pages", F.lit(max(1, -(-total // limit))))
            .withColumn("has_more", F.lit(start + limit < total)))
