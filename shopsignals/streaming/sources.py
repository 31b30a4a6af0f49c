"""Event-stream sources.

File sources carry a fixed schema (no inference on a stream); a Kafka-style
value column is parsed with ``from_json``. ``server_ts`` is the ingest stamp.
``max_files`` bounds each micro-batch (the reference reads 50 messages per
poll; here it is a trigger option, not a loop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLICK_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
])

COMPETITOR_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("competitor", T.StringType()),
    T.StructField("price", T.StringType()),
])


def _stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str, max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path).withColumn("server_ts", F.current_timestamp())


def click_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None,
                 schema: T.StructType = CLICK_SCHEMA) -> DataFrame:
    """Click events with the ingest stamp."""
    return _stream(spark, path, schema, fmt, max_files)


def competitor_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None,
                      schema: T.StructType = COMPETITOR_SCHEMA) -> DataFrame:
    """Competitor price events (price stays a string until validated)."""
    return _stream(spark, path, schema, fmt, max_files)


def parse_json_events(df: DataFrame, schema: T.StructType, value_col: str = "value") -> DataFrame:
    """Message values (e.g. a Kafka topic) → typed columns."""
    return df.select(F.from_json(F.col(value_col).cast("string"), schema).alias("e")).select("e.*") \
             .withColumn("server_ts", F.current_timestamp())
