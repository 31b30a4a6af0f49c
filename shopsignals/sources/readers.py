"""Typed readers for the reference's raw inputs.

Schemas are explicit: ``inferSchema`` on a multi-terabyte CSV is a full extra
scan and gives unstable types. NaN is turned into NULL at the scan (pandas
aggregates skip NaN, Spark aggregates only skip NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsignals.operators.ranks import hash_number, smallest

CLICKSTREAM_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("user_segment", T.StringType()),
    T.StructField("price_seen_usd", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("session_duration_s", T.DoubleType()),
    T.StructField("scroll_depth_pct", T.DoubleType()),
    T.StructField("time_on_page_s", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("referral_source", T.StringType()),
    T.StructField("hour_of_day", T.IntegerType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("sku_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("base_price_usd", T.DoubleType()),
    T.StructField("cost_price_usd", T.DoubleType()),
    T.StructField("current_price_usd", T.DoubleType()),
    T.StructField("min_price_usd", T.DoubleType()),
    T.StructField("max_price_usd", T.DoubleType()),
    T.StructField("inventory_count", T.IntegerType()),
    T.StructField("restock_days", T.DoubleType()),
    T.StructField("avg_rating", T.DoubleType()),
    T.StructField("review_count", T.IntegerType()),
    T.StructField("is_active", T.StringType()),
    T.StructField("launch_date", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("weight_kg", T.DoubleType()),
    T.StructField("image_url", T.StringType()),
])

COMPETITOR_SCHEMA = T.StructType([
    T.StructField("sku_id", T.StringType()),
    T.StructField("competitor", T.StringType()),
    T.StructField("competitor_price", T.DoubleType()),
    T.StructField("price_delta_pct", T.DoubleType()),
    T.StructField("is_on_promotion", T.BooleanType()),
    T.StructField("in_stock", T.BooleanType()),
    T.StructField("timestamp", T.TimestampType()),
])

PROFILE_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("willingness_to_pay_multiplier", T.DoubleType()),
    T.StructField("lifetime_value_usd", T.DoubleType()),
    T.StructField("avg_order_value_usd", T.DoubleType()),
    T.StructField("cart_abandonment_rate", T.DoubleType()),
    T.StructField("purchase_frequency", T.DoubleType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("country", T.StringType()),
])


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "csv":
        df = (spark.read.schema(schema).option("header", "true")
              .option("mode", "PERMISSIVE").csv(path))
    elif fmt == "json":
        df = spark.read.schema(schema).json(path)
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN → NULL on every floating column (rule N2)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_clickstream(spark, path, fmt="parquet") -> DataFrame:
    """A1 (A5: Catalyst prunes unused columns at the scan)."""
    return _read(spark, path, CLICKSTREAM_SCHEMA, fmt)


def read_catalog(spark, path, fmt="parquet") -> DataFrame:
    """A2."""
    return _read(spark, path, CATALOG_SCHEMA, fmt)


def read_competitor_feed(spark, path, fmt="parquet") -> DataFrame:
    """A3."""
    return _read(spark, path, COMPETITOR_SCHEMA, fmt)


def read_profiles(spark, path, fmt="parquet") -> DataFrame:
    """A4."""
    return _read(spark, path, PROFILE_SCHEMA, fmt)


def head_events(df: DataFrame, n: int, order_by: str = "event_id") -> DataFrame:
    """First ``n`` rows in a stated order (repeatable, unlike file order);
    rows without an order key are left out, ties go by the other columns.

    For numbers and times the n-th key is found from histograms and the rows up to
    it are a filter that reaches the scan, whatever ``n``; they are sorted by range,
    no rows are merged in one task. Other keys fall back on a sort, which keeps n rows per task.
    """
    kind = df.schema[order_by].dataType
    exact = {"timestamp": F.unix_micros, "date": F.unix_date}.get(kind.typeName())
    if kind.typeName() not in ("byte", "short", "integer", "long", "timestamp", "date"):
        return df.where(F.col(order_by).isNotNull()).orderBy(F.col(order_by).asc()).limit(n)
    ties = [F.col(c) for c in df.columns if c != order_by]
    key = exact(F.col(order_by)) if kind.typeName() in ("timestamp", "date") else F.col(order_by)
    return smallest(df, key, n, ties).orderBy(order_by, *ties)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of exactly ``n`` rows (all with a key, if fewer): those
    with the smallest hash of the key, ties by key and the other columns. The
    threshold is found from mergeable histograms of the hash, so that one filter
    makes the sample; it is the same for any partitioning and engine."""
    return smallest(df, hash_number(F.col(key), seed), n, [F.col(key), *[F.col(c) for c in df.columns if c != key]])


def sample_groups(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of a seeded sample of exactly ``n`` keys (baskets)."""
    chosen = sample_rows(df.select(key).where(F.col(key).isNotNull()).distinct(), key, n, seed)
    return df.join(chosen, key, "left_semi").select(*df.columns)


def sample_keyed(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Seeded sample by a hash of the key: rows whose first 32 bits of
    md5(key ":" seed) lie below ``fraction`` of their range; no row without key.

    Membership depends only on (key, seed), so the sample is the same for any
    partitioning and engine and survives task retries.
    """
    if fraction >= 1:
        return df.where(F.col(key).isNotNull())
    h = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8)
    return df.where(h < F.lit(f"{round(fraction * 2 ** 32):08x}"))
