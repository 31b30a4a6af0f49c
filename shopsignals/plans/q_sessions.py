"""Registered queries: session sequences, vocabulary, context, next-item samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsignals.operators import sessions as ss
from shopsignals.plans.registry import query

SEQ = ("fx_clickstream", "fx_catalog")

E6_SQL = """
WITH v AS (SELECT sku_id, row_number() OVER (ORDER BY sku_id) AS item_idx FROM (SELECT DISTINCT sku_id FROM fx_catalog
  WHERE sku_id IS NOT NULL)),
 e AS (SELECT c.session_id, c.event_id, c.sku_id, v.item_idx, c.timestamp,
  count(*) OVER (PARTITION BY c.session_id) AS n,
  row_number() OVER (PARTITION BY c.session_id ORDER BY c.timestamp DESC, c.event_id DESC) AS rdesc
  FROM fx_clickstream c JOIN v ON c.sku_id = v.sku_id
  WHERE c.timestamp IS NOT NULL AND c.session_id IS NOT NULL
  AND c.event_type IN ('page_view', 'product_view', 'add_to_cart', 'purchase', 'search'))
SELECT session_id, event_id, sku_id, item_idx, least(n, 50) - rdesc + 1 AS pos, least(n, 50) AS seq_len
FROM e WHERE n >= 3 AND rdesc <= 50"""


@query("e11_build_vocab", "sku_id:i item_idx:i", views=("fx_catalog",), oracle="""
SELECT sku_id, row_number() OVER (ORDER BY sku_id) AS item_idx FROM (SELECT DISTINCT sku_id FROM fx_catalog)""")
def e11(fx):
    """SKU vocabulary, index from 1."""
    return ss.build_vocab(fx("fx_catalog"))


@query("e6_session_sequences", "session_id:s event_id:i sku_id:i item_idx:i pos:i seq_len:i", views=SEQ,
       oracle=E6_SQL)
def e6(fx):
    """Last-50 interaction sequences of sessions with ≥ 3 events."""
    return ss.session_sequences(fx("fx_clickstream"), fx("fx_catalog"))


@query("e7_next_item_samples", "session_id:s end_idx:i target:i prefix_len:i first_input:i last_input:i "
       "n_masked:i", views=SEQ, oracle=f"""
WITH s AS ({E6_SQL}), g AS (SELECT session_id, max(seq_len) AS n FROM s GROUP BY session_id),
 x AS (SELECT g.session_id, k.end_idx FROM g, LATERAL (SELECT unnest(range(3, g.n + 1)) AS end_idx) k)
SELECT x.session_id, x.end_idx, t.item_idx AS target, x.end_idx - 1 AS prefix_len,
 CASE WHEN x.end_idx - 1 = 50 THEN f.item_idx ELSE 0 END AS first_input, l.item_idx AS last_input,
 50 - (x.end_idx - 1) AS n_masked
FROM x JOIN s t ON t.session_id = x.session_id AND t.pos = x.end_idx
 JOIN s l ON l.session_id = x.session_id AND l.pos = x.end_idx - 1
 JOIN s f ON f.session_id = x.session_id AND f.pos = 1""")
def e7(fx):
    """Sliding prefix → next item, padded to 50 with a mask."""
    arr = ss.sequence_arrays(ss.session_sequences(fx("fx_clickstream"), fx("fx_catalog")))
    s = ss.next_item_samples(arr)
    return s.select("session_id", "end_idx", "target", "prefix_len",
                    F.element_at("padded", 1).alias("first_input"),
                    F.element_at("padded", 50).alias("last_input"),
                    F.size(F.filter("mask", lambda m: m)).alias("n_masked"))


@query("e12_session_context", "session_id:s device_idx:i referral_idx:i hour_norm:d ctx_len:i ctx_sum:d",
       views=("fx_clickstream", "fx_catalog"), oracle="""
WITH e AS (SELECT * FROM fx_clickstream WHERE session_id IS NOT NULL
  AND event_type IN ('page_view', 'product_view', 'add_to_cart', 'purchase', 'search')),
 f AS (SELECT session_id, arg_min(device_type, (timestamp, event_id)) AS device_type,
  arg_min(referral_source, (timestamp, event_id)) AS referral_source,
  arg_min(hour_of_day, (timestamp, event_id)) AS hour_of_day FROM e
  WHERE sku_id IN (SELECT sku_id FROM fx_catalog) GROUP BY session_id),
 d AS (SELECT device_type, row_number() OVER (ORDER BY device_type) - 1 AS device_idx FROM (SELECT DISTINCT device_type FROM e)),
 r AS (SELECT referral_source, row_number() OVER (ORDER BY referral_source) - 1 AS referral_idx FROM (SELECT DISTINCT referral_source FROM e))
SELECT f.session_id, d.device_idx, r.referral_idx, CAST(f.hour_of_day AS DOUBLE) / 24.0 AS hour_norm,
 (SELECT count(*) FROM d) + (SELECT count(*) FROM r) + 1 AS ctx_len, 2.0 + CAST(f.hour_of_day AS DOUBLE) / 24.0 AS ctx_sum
FROM f JOIN d USING (device_type) JOIN r USING (referral_source)""")
def e12(fx):
    """One-hot device/referral + hour of the session's first catalog-SKU event."""
    c = ss.session_context(fx("fx_clickstream"), catalog=fx("fx_catalog"))
    return c.select("session_id", "device_idx", "referral_idx", "hour_norm",
                    F.size("context").alias("ctx_len"),
                    F.aggregate("context", F.lit(0.0), lambda a, x: a + x).alias("ctx_sum"))


@query("k7_window_kpis", "window_start:s events:i page_view:i search:i cart:i purchase:i wishlist:i active_sessions:i", views=("fx_live_clicks",), oracle="""
WITH e AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, timestamp) - INTERVAL 5 MINUTE * unnest(range(6)) AS w FROM fx_live_clicks WHERE timestamp IS NOT NULL)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS events, count_if(event_type = 'page_view') AS page_view, count_if(event_type = 'search') AS search,
 count_if(event_type = 'cart') AS cart, count_if(event_type = 'purchase') AS purchase, count_if(event_type = 'wishlist') AS wishlist,
 count(DISTINCT session_id) AS active_sessions FROM e GROUP BY w""")
def k7(fx):
    """K7 in batch: event counters and active sessions of every 30-minute window, each five minutes."""
    out = ss.window_kpis(fx("fx_live_clicks"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
