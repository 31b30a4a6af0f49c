"""Registered queries: bounded/sampled scans, validation, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsignals.functions import columns as fn
from shopsignals.plans.registry import query
from shopsignals.sources import readers
from shopsignals.streaming.operators import validity


@query("a6_head_events", "event_id:i sku_id:i event_type:s", views=("fx_clickstream",), oracle="""
SELECT event_id, sku_id, event_type FROM fx_clickstream ORDER BY event_id LIMIT 250000""")
def a6(fx):
    """The first 250,000 events in event order (the reference's bounded read)."""
    return readers.head_events(fx("fx_clickstream").select("event_id", "sku_id", "event_type"), 250_000)


@query("a7_sample_keyed", "event_id:i user_id:i", views=("fx_clickstream",), oracle="""
SELECT event_id, user_id FROM fx_clickstream WHERE substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 8) < '80000000'""")
def a7(fx):
    """Seeded keyed sample (50 % by a hash of event_id, seed 42)."""
    return readers.sample_keyed(fx("fx_clickstream").select("event_id", "user_id"), "event_id", 0.5, 42)


@query("a7_sample_rows", "event_id:i user_id:i event_type:s", views=("fx_clickstream",), oracle="""
SELECT event_id, user_id, event_type FROM fx_clickstream WHERE event_id IS NOT NULL
ORDER BY substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 15), event_id LIMIT 5000""")
def a7_rows(fx):
    """A seeded sample of exactly 5,000 events."""
    return readers.sample_rows(fx("fx_clickstream").select("event_id", "user_id", "event_type"), "event_id", 5000, 42)


@query("a7_sample_baskets", "order_id:i product_id:i", views=("fx_orders",), oracle="""
WITH k AS (SELECT DISTINCT order_id FROM fx_orders),
 s AS (SELECT order_id FROM k ORDER BY substr(md5(CAST(order_id AS VARCHAR) || ':42'), 1, 15), order_id LIMIT 1000)
SELECT order_id, product_id FROM fx_orders WHERE order_id IN (SELECT order_id FROM s)""")
def a7_baskets(fx):
    """All lines of a seeded sample of exactly 1,000 baskets."""
    return readers.sample_groups(fx("fx_orders").select("order_id", "product_id"), "order_id", 1000, 42)


@query("b15_validate_events", "event_id:i is_valid:b", views=("fx_clickstream",), oracle="""
SELECT event_id, user_id IS NOT NULL AND CAST(user_id AS VARCHAR) <> '' AND session_id IS NOT NULL AND session_id <> ''
 AND sku_id IS NOT NULL AND CAST(sku_id AS VARCHAR) <> '' AND event_type IS NOT NULL AND event_type <> ''
 AND event_type IN ('page_view', 'search', 'cart', 'purchase', 'wishlist') AS is_valid FROM fx_clickstream""")
def b15(fx):
    """Live-event validation flag over the batch clickstream vocabulary."""
    ev = fx("fx_clickstream").withColumnRenamed("sku_id", "product_id")
    return ev.select("event_id", validity(ev).alias("is_valid"))


@query("b16_scalar_functions",
       "sku_id:i launch_num:d inv_int:i first_nonzero:d price_usd:d rating_clipped:d log_reviews:d back:d",
       views=("fx_catalog",), oracle="""
SELECT sku_id, coalesce(TRY_CAST(launch_date AS DOUBLE), -1.0) AS launch_num,
 coalesce(CAST(TRY_CAST(CAST(inventory_count AS VARCHAR) AS DOUBLE) AS BIGINT), 0) AS inv_int,
 coalesce(nullif(CAST(inventory_count AS DOUBLE), 0), nullif(CAST(review_count AS DOUBLE), 0), nullif(weight_kg, 0), 0.0) AS first_nonzero,
 round(base_price_usd * 0.012 * 100.0) / 100.0 AS price_usd,
 CASE WHEN avg_rating IS NULL THEN NULL WHEN avg_rating < 2.0 THEN 2.0 WHEN avg_rating > 4.0 THEN 4.0 ELSE avg_rating END AS rating_clipped,
 ln(1 + review_count) AS log_reviews, exp(ln(1 + review_count)) - 1 AS back FROM fx_catalog""")
def b16(fx):
    """B16 safe parses, B17 first non-zero, B18 INR→USD, B20 clip, B21 log1p/expm1."""
    c = fx("fx_catalog")
    return c.select(
        "sku_id", fn.safe_float("launch_date", -1.0).alias("launch_num"),
        fn.safe_int(F.col("inventory_count").cast("string"), 0).alias("inv_int"),
        fn.first_nonzero(F.col("inventory_count").cast("double"), F.col("review_count").cast("double"),
                         "weight_kg").alias("first_nonzero"),
        fn.to_usd("base_price_usd").alias("price_usd"),
        fn.clip("avg_rating", 2.0, 4.0).alias("rating_clipped"),
        F.log1p("review_count").alias("log_reviews"), F.expm1(F.log1p("review_count")).alias("back"))


@query("b2_event_weights", "event_id:i demand_w:d popularity_w:d live_w:d coarse:s", views=("fx_clickstream",),
       oracle="""
SELECT event_id,
 CASE event_type WHEN 'page_view' THEN 1 WHEN 'product_view' THEN 2 WHEN 'search' THEN 1 WHEN 'add_to_cart' THEN 4
  WHEN 'add_to_wishlist' THEN 3 WHEN 'checkout_start' THEN 5 WHEN 'purchase' THEN 7 WHEN 'remove_from_cart' THEN -1
  WHEN 'page_exit' THEN 0 ELSE 1 END AS demand_w,
 CASE event_type WHEN 'page_view' THEN 1 WHEN 'product_view' THEN 2 WHEN 'search' THEN 1 WHEN 'add_to_cart' THEN 3
  WHEN 'add_to_wishlist' THEN 2 WHEN 'checkout_start' THEN 4 WHEN 'purchase' THEN 5 WHEN 'remove_from_cart' THEN 0
  WHEN 'page_exit' THEN 0 ELSE 1 END AS popularity_w,
 CASE event_type WHEN 'page_view' THEN 0.05 WHEN 'search' THEN 0.10 WHEN 'cart' THEN 0.40 WHEN 'purchase' THEN 1.0
  WHEN 'wishlist' THEN 0.25 ELSE 0.05 END AS live_w,
 CASE WHEN event_type IN ('add_to_cart', 'add_to_wishlist', 'checkout_start') THEN 'cart'
  WHEN event_type = 'purchase' THEN 'purchase' ELSE 'view' END AS coarse
FROM fx_clickstream""")
def b2(fx):
    """Event weights on the three scales and the coarse relabel."""
    return fx("fx_clickstream").select(
        "event_id", fn.event_weight("event_type", "demand").alias("demand_w"),
        fn.event_weight("event_type", "popularity").alias("popularity_w"),
        fn.event_weight("event_type", "live").alias("live_w"),
        fn.coarse_event_type("event_type").alias("coarse"))
