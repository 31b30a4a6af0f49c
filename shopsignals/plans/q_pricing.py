"""Registered queries: live pricing, catalog pricing and stream batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shopsignals.operators import pricing as pr
from shopsignals.operators import sessions as ss
from shopsignals.plans.registry import query

LIVE = ("fx_live_clicks", "fx_catalog")


def _active(fx):
    """The service catalog the daily price is computed for: active rows (B1)."""
    from shopsignals.operators.catalog import clean_catalog

    return clean_catalog(fx("fx_catalog"))

# ------------------------------------------------------------- shared oracle SQL
_LW = ("CASE event_type WHEN 'page_view' THEN 0.05 WHEN 'search' THEN 0.10 WHEN 'cart' THEN 0.40 "
       "WHEN 'purchase' THEN 1.00 WHEN 'wishlist' THEN 0.25 ELSE 0.05 END")
_IB = ("CASE event_type WHEN 'cart' THEN 0.65 WHEN 'wishlist' THEN 0.40 WHEN 'search' THEN 0.20 "
       "WHEN 'page_view' THEN 0.08 ELSE 0.05 END")


def _r(x, d):
    k = f"{10 ** d}.0"
    return f"(round(({x}) * {k}) / {k})"


K3_SQL = f"""
SELECT *, CASE WHEN base IS NULL THEN 0.0 ELSE {_r('base * (0.70 + intent_probability * 0.40)', 2)} END AS wtp_estimate
FROM (SELECT *, {_r(f'least({_IB} + engagement_score * 0.2, 1.0)', 4)} AS intent_probability
 FROM (SELECT *, {_r(f'0.6 * least(session_length / 20.0, 1.0) + 0.4 * {_LW}', 4)} AS engagement_score
  FROM (SELECT *, pos - max(CASE WHEN nw THEN pos END) OVER (PARTITION BY session_id ORDER BY timestamp, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS session_length
   FROM (SELECT e.*, c.base_price_usd AS base,
    row_number() OVER (PARTITION BY e.session_id ORDER BY e.timestamp, e.event_id) AS pos,
    coalesce(epoch_us(e.timestamp) - lag(epoch_us(e.timestamp)) OVER (PARTITION BY e.session_id
     ORDER BY e.timestamp, e.event_id) > 1800000000, true) AS nw
    FROM fx_live_clicks e LEFT JOIN fx_catalog c ON e.product_id = c.sku_id
    WHERE e.session_id IS NOT NULL AND CAST(e.session_id AS VARCHAR) <> ''))))"""

K3_FINAL_SQL = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, event_id DESC) AS rn
 FROM ({K3_SQL})) WHERE rn = 1"""

SNAP_SQL = """
SELECT sku_id AS product_id, min(price) AS min, max(price) AS max, count(*) AS n_competitors
FROM (SELECT sku_id, competitor, competitor_price AS price,
 row_number() OVER (PARTITION BY sku_id, competitor ORDER BY timestamp DESC, competitor_price DESC) AS rn
 FROM fx_competitor WHERE competitor_price IS NOT NULL AND sku_id IS NOT NULL) WHERE rn = 1 GROUP BY sku_id"""


def _features(fx):
    return ss.session_features_batch(fx("fx_live_clicks"), fx("fx_catalog"), final_only=True)


def _products(fx):
    return fx("fx_catalog").select(F.col("sku_id").alias("product_id"),
                                   F.col("base_price_usd").alias("base_price"), "product_name")


def _snapshot(fx):
    feed = fx("fx_competitor").select(F.col("sku_id").alias("product_id"), "competitor",
                                      F.col("competitor_price").alias("price"), "timestamp")
    return ss.competitor_snapshot(feed)


def _requests(fx):
    return (fx("fx_live_clicks").where(F.col("event_type") == "cart")
            .select("event_id", "product_id", "user_id", "session_id", "timestamp"))


# ------------------------------------------------------------------ K3 / E5
@query("k3_session_features_batch",
       "event_id:i session_id:s session_length:i engagement_score:d intent_probability:d wtp_estimate:d",
       views=LIVE, oracle=K3_SQL)
def k3(fx):
    """K3: per-event session features (batch twin of the stream operator)."""
    return ss.session_features_batch(fx("fx_live_clicks"), fx("fx_catalog"))


@query("k3_session_features_final",
       "session_id:s user_id:i session_length:i engagement_score:d intent_probability:d wtp_estimate:d "
       "last_event_type:s last_product_id:i", views=LIVE,
       oracle=f"SELECT *, event_type AS last_event_type, product_id AS last_product_id FROM ({K3_FINAL_SQL})")
def k3f(fx):
    """K3: the final feature row per session."""
    return _features(fx)


@query("e5_session_progress", "event_id:i session_id:s session_length:i", views=("fx_clickstream",), oracle="""
SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS session_length
FROM fx_clickstream""")
def e5(fx):
    """E5: running session length per event."""
    return ss.session_progress(fx("fx_clickstream"))


# ------------------------------------------------------------------------ D25
@query("d25_competitor_snapshot", "product_id:i min:d max:d n_competitors:i", views=("fx_competitor",),
       oracle=SNAP_SQL)
def d25(fx):
    """Latest price per (product, competitor) → min/max per product."""
    return _snapshot(fx)


@query("c12_competitor_or_seed", "product_id:i competitor_min:d competitor_max:d is_live:b",
       views=("fx_competitor", "fx_catalog"), oracle=f"""
SELECT c.sku_id AS product_id, coalesce(s.min, c.base_price_usd * 0.97) AS competitor_min,
 coalesce(s.max, c.base_price_usd * 0.97) AS competitor_max, s.min IS NOT NULL AS is_live
FROM fx_catalog c LEFT JOIN ({SNAP_SQL}) s ON c.sku_id = s.product_id""")
def c12(fx):
    """Live competitor range with a seeded fallback (seed = 0.97 × base)."""
    seed = fx("fx_catalog").select(F.col("sku_id").alias("product_id"),
                                   (F.col("base_price_usd") * 0.97).alias("seed_price"))
    return pr.competitor_or_seed(_snapshot(fx), seed)


# ------------------------------------------------------------------------ D26
@query("d26_user_affinity", "user_id:i category:s score:d top_category:s", views=LIVE, oracle=f"""
WITH a AS (SELECT e.user_id, c.category, sum({_LW}) AS score FROM fx_live_clicks e
  JOIN fx_catalog c ON e.product_id = c.sku_id WHERE e.user_id IS NOT NULL AND c.category IS NOT NULL
  GROUP BY e.user_id, c.category),
 t AS (SELECT user_id, category AS top_category FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY round(score, 12) DESC, category) AS rn FROM a) WHERE rn = 1)
SELECT a.*, t.top_category FROM a JOIN t USING (user_id)""")
def d26(fx):
    """User × category affinity with the top category."""
    return ss.user_affinity(fx("fx_live_clicks"), fx("fx_catalog"))


@query("d26_user_affinity_ttl", "user_id:i category:s score:d top_category:s", views=LIVE, oracle=f"""
WITH j AS (SELECT e.user_id, e.event_id, e.timestamp, e.event_type, c.category FROM fx_live_clicks e
  JOIN fx_catalog c ON e.product_id = c.sku_id WHERE e.user_id IS NOT NULL AND c.category IS NOT NULL),
 g AS (SELECT *, coalesce(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY user_id
  ORDER BY timestamp, event_id) > 86400000000, false) AS gap,
  row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS pos FROM j),
 lr AS (SELECT user_id, max(CASE WHEN gap THEN pos END) AS r FROM g GROUP BY user_id),
 s AS (SELECT g.* FROM g JOIN lr ON g.user_id = lr.user_id WHERE lr.r IS NULL OR g.pos >= lr.r),
 a AS (SELECT user_id, category, sum({_LW}) AS score FROM s GROUP BY user_id, category),
 t AS (SELECT user_id, category AS top_category FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY round(score, 12) DESC, category) AS rn FROM a) WHERE rn = 1)
SELECT a.*, t.top_category FROM a JOIN t USING (user_id)""")
def d26t(fx):
    """D26 with the 24 h affinity expiry (K5's batch twin)."""
    return ss.user_affinity(fx("fx_live_clicks"), fx("fx_catalog"), ttl_seconds=86400)


# ------------------------------------------------------------------------ D27
@query("d27_session_view", "user_id:i n_products:i first_product:i total_views:i top_category:s "
       "journey_explanation:s", views=LIVE, oracle="""
WITH f AS (SELECT user_id, product_id, min(timestamp) AS ts, min_by(event_id, (timestamp, event_id)) AS eid
  FROM fx_live_clicks GROUP BY user_id, product_id),
 s AS (SELECT f.*, c.category FROM f JOIN fx_catalog c ON f.product_id = c.sku_id),
 cc AS (SELECT user_id, category, count(*) AS n, min((ts, eid)) AS fs FROM s GROUP BY user_id, category),
 t AS (SELECT user_id, category AS top_category FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY n DESC, fs) AS rn FROM cc) WHERE rn = 1),
 p AS (SELECT user_id, count(*) AS total_views, arg_min(product_id, (ts, eid)) AS first_product FROM s GROUP BY user_id)
SELECT p.user_id, p.total_views AS n_products, p.first_product, p.total_views, t.top_category,
 'You''ve explored ' || CAST(p.total_views AS VARCHAR) || ' product(s), showing strong interest in ' ||
 t.top_category || '. We''re tailoring recommendations based on your journey.' AS journey_explanation
FROM p JOIN t USING (user_id)""")
def d27(fx):
    """D27 + C11: per-user session summary."""
    v = ss.session_view(fx("fx_live_clicks"), fx("fx_catalog"))
    return v.withColumn("n_products", F.col("total_views"))


@query("d27_session_products", "user_id:i position:i product_id:i", views=LIVE, oracle="""
WITH f AS (SELECT user_id, product_id, min(timestamp) AS ts, min_by(event_id, (timestamp, event_id)) AS eid
  FROM fx_live_clicks WHERE user_id IS NOT NULL AND product_id IS NOT NULL GROUP BY user_id, product_id),
 s AS (SELECT f.* FROM f JOIN fx_catalog c ON f.product_id = c.sku_id)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, eid) AS position, product_id FROM s""")
def d27p(fx):
    """Each user's viewed catalog products in first-seen order (long form)."""
    return ss.session_view_products(fx("fx_live_clicks"), fx("fx_catalog"))


# ------------------------------------------------------------------ I1 – I4
_REQUESTS_SQL = """SELECT event_id, product_id, user_id, session_id FROM fx_live_clicks
 WHERE event_type = 'cart' AND product_id IS NOT NULL AND user_id IS NOT NULL AND session_id <> ''"""
I4_SQL = f"""
WITH r AS ({_REQUESTS_SQL}),
 f AS (SELECT session_id, intent_probability, engagement_score, wtp_estimate FROM ({K3_FINAL_SQL})),
 s AS ({SNAP_SQL}),
 j AS (SELECT r.*, c.base_price_usd AS base_price, coalesce(f.intent_probability, 0.05) AS intent_probability,
  coalesce(f.engagement_score, 0.1) AS engagement_score, coalesce(f.wtp_estimate, 0.0) AS wtp_estimate,
  s.min AS competitor_min
  FROM r JOIN fx_catalog c ON r.product_id = c.sku_id LEFT JOIN f ON r.session_id = f.session_id
  LEFT JOIN s ON r.product_id = s.product_id),
 m AS (SELECT *, 1.0 + (0.6 * intent_probability + 0.4 * engagement_score - 0.3) * 0.15 AS m0 FROM j),
 m2 AS (SELECT *, CASE WHEN competitor_min > 0 AND base_price / competitor_min > 1.05 THEN m0 * 0.97
  WHEN competitor_min > 0 AND base_price / competitor_min < 0.90 THEN m0 * 1.02 ELSE m0 END AS m1 FROM m),
 m3 AS (SELECT *, {_r('base_price * CASE WHEN wtp_estimate > 0 THEN 0.7 * m1 + 0.3 * wtp_estimate / base_price ELSE m1 END', 2)} AS raw_price FROM m2),
 p AS (SELECT *, CASE WHEN raw_price < base_price * 0.1 THEN {_r('base_price * 0.1', 2)}
  WHEN raw_price < base_price * 0.7 THEN {_r('base_price * 0.7', 2)}
  WHEN raw_price > base_price * 1.2 THEN {_r('base_price * 1.2', 2)} ELSE {_r('raw_price', 2)} END AS final_price,
  CASE WHEN raw_price < base_price * 0.1 THEN 'Minimum margin floor applied'
  WHEN raw_price < base_price * 0.7 THEN 'Discount capped at 30%'
  WHEN raw_price > base_price * 1.2 THEN 'Premium capped at 20%' ELSE '' END AS rule_reason FROM m3)
SELECT *, CASE WHEN rule_reason <> '' THEN rule_reason
 WHEN intent_probability > 0.6 THEN 'Price adjusted based on high purchase intent in your session'
 WHEN engagement_score > 0.7 THEN 'Personalised price based on your browsing activity'
 WHEN (base_price - final_price) / base_price > 0.15 THEN 'You''re getting a ' ||
   CAST(CAST(floor((base_price - final_price) / base_price * 100) AS BIGINT) AS VARCHAR) || '% discount — demand is lower right now'
 WHEN final_price > base_price THEN 'Price slightly higher due to current high demand'
 ELSE 'Competitive price based on current market conditions' END AS reason,
 {_r('(base_price - final_price) / base_price * 100', 1)} AS discount_pct
FROM p"""


@query("i4_price_requests",
       "event_id:i product_id:i user_id:i session_id:s base_price:d intent_probability:d engagement_score:d "
       "wtp_estimate:d competitor_min:d raw_price:d final_price:d rule_reason:s reason:s discount_pct:d",
       views=LIVE + ("fx_competitor",), oracle=I4_SQL)
def i4(fx):
    """Batch of live price requests (cart events) priced from session
    features and the competitor snapshot."""
    return pr.price_requests(_requests(fx), _products(fx), _features(fx), _snapshot(fx))


# the cache by its definition: from each computed request to the next one at least 60 s later
I4_CACHED_SQL = f"""
WITH RECURSIVE t AS (SELECT q.*, r.timestamp, row_number() OVER (PARTITION BY q.product_id, q.user_id ORDER BY r.timestamp, q.event_id) AS i
  FROM ({I4_SQL.replace(_REQUESTS_SQL, "SELECT event_id, product_id, user_id, session_id FROM fx_price_requests WHERE session_id <> ''")}) q
  JOIN fx_price_requests r USING (event_id)),
 nx AS (SELECT a.product_id, a.user_id, a.i, min(b.i) AS j FROM t a JOIN t b ON a.product_id = b.product_id AND a.user_id = b.user_id
  AND b.timestamp >= a.timestamp + INTERVAL 60 SECOND GROUP BY a.product_id, a.user_id, a.i),
 an AS (SELECT product_id, user_id, CAST(1 AS BIGINT) AS i FROM t WHERE i = 1
  UNION ALL SELECT nx.product_id, nx.user_id, nx.j FROM an JOIN nx ON an.product_id = nx.product_id AND an.user_id = nx.user_id AND an.i = nx.i),
 w AS (SELECT t.product_id, t.user_id, t.event_id, t.i, max(an.i) AS k FROM t JOIN an ON t.product_id = an.product_id
  AND t.user_id = an.user_id AND an.i <= t.i GROUP BY t.product_id, t.user_id, t.event_id, t.i)
SELECT w.event_id, w.product_id, w.user_id, 'A' AS variant, c.base_price, c.final_price, c.reason, c.discount_pct, w.k <> w.i AS cache_hit
FROM w JOIN t c ON w.product_id = c.product_id AND w.user_id = c.user_id AND w.k = c.i"""


@query("i4_cached_prices",
       "event_id:i product_id:i user_id:i variant:s base_price:d final_price:d reason:s discount_pct:d cache_hit:b",
       views=LIVE + ("fx_competitor", "fx_price_requests"), oracle=I4_CACHED_SQL)
def i4_cached(fx):
    """I4: repeated price requests; a price computed less than 60 s before is given again."""
    return pr.serve_cached(pr.price_requests(fx("fx_price_requests"), _products(fx), _features(fx), _snapshot(fx)))


@query("i5_explain_prices",
       "event_id:i product_id:i user_id:i your_price:d discount_pct:d reason:s intent_probability:d "
       "session_length:i last_event:s is_cached:b", views=LIVE + ("fx_competitor",), oracle=f"""
WITH q AS ({I4_SQL}),
 lg AS (SELECT product_id, user_id, final_price, reason, timestamp FROM q JOIN fx_live_clicks USING (event_id, product_id, user_id, session_id)),
 fr AS (SELECT * FROM lg WHERE timestamp <= TIMESTAMP '2024-01-20 00:00:00'
   AND timestamp > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 86400 SECOND),
 la AS (SELECT product_id, user_id, arg_max(final_price, (timestamp, final_price, reason)) AS cached_price,
   arg_max(reason, (timestamp, final_price, reason)) AS cached_reason FROM fr GROUP BY product_id, user_id),
 r AS (SELECT event_id, product_id, user_id, session_id FROM fx_live_clicks WHERE event_type = 'purchase'),
 f AS ({K3_FINAL_SQL})
SELECT r.event_id, r.product_id, r.user_id, coalesce(la.cached_price, c.base_price_usd) AS your_price,
 {_r('(c.base_price_usd - coalesce(la.cached_price, c.base_price_usd)) / c.base_price_usd * 100', 1)} AS discount_pct,
 coalesce(la.cached_reason, 'Standard pricing') AS reason, coalesce(f.intent_probability, 0.05) AS intent_probability,
 coalesce(f.session_length, 0) AS session_length, coalesce(f.event_type, 'page_view') AS last_event,
 la.cached_price IS NOT NULL AS is_cached
FROM r JOIN fx_catalog c ON r.product_id = c.sku_id LEFT JOIN la ON r.product_id = la.product_id AND r.user_id = la.user_id
LEFT JOIN f ON r.session_id = f.session_id""")
def i5(fx):
    """Explanation view for purchase events against the pricing log of cart requests."""
    priced = pr.price_requests(_requests(fx), _products(fx), _features(fx), _snapshot(fx))
    log = priced.select("product_id", "user_id", "final_price", "reason", "timestamp")
    req = (fx("fx_live_clicks").where(F.col("event_type") == "purchase")
           .select("event_id", "product_id", "user_id", "session_id"))
    return pr.explain_prices(req, _products(fx), log, _features(fx), _snapshot(fx),
                             as_of="2024-01-20 00:00:00", ttl_seconds=86400)


# ------------------------------------------------------------------------- I6
I6_SQL = f"""
WITH b AS (SELECT sku_id, coalesce(base_price_usd, 0) AS base, coalesce(current_price_usd, base_price_usd, 0) AS cur,
  coalesce(inventory_count, 0) AS inv, coalesce(avg_rating, 0) AS rating, coalesce(review_count, 0) AS reviews
  FROM fx_catalog_active),
 m AS (SELECT *, least(greatest(CASE WHEN cur > 0 THEN cur / cur ELSE 1.0 END, 0.7), 1.5) AS ml,
  CASE WHEN inv < 20 THEN 1.08 WHEN inv > 500 THEN 0.95 ELSE 1.0 END AS ia,
  CASE WHEN rating >= 4.5 AND reviews > 100 THEN 1.05 WHEN rating < 2.5 AND reviews > 20 THEN 0.92 ELSE 1.0 END AS ra,
  1 + CASE WHEN inv < 20 OR inv > 500 THEN 1 ELSE 0 END
    + CASE WHEN (rating >= 4.5 AND reviews > 100) OR (rating < 2.5 AND reviews > 20) THEN 1 ELSE 0 END AS n_adj FROM b),
 f AS (SELECT *, {_r('greatest(cur * ml * ia * ra, base * 0.70)', 2)} AS final_price FROM m),
 s AS (SELECT *, {_r('cur - final_price', 2)} AS total_savings FROM f)
SELECT sku_id AS product_id, {_r('cur', 2)} AS base_price, final_price, total_savings,
 CASE WHEN cur > 0 THEN {_r('total_savings / cur * 100', 1)} ELSE 0.0 END AS savings_percent, n_adj AS n_adjustments,
 CASE WHEN inv < 20 THEN 'Low Stock Premium' WHEN inv > 500 THEN 'Overstock Discount' ELSE '' END AS stock_factor,
 ml AS ml_factor, '2024-01-01' AS cache_date FROM s"""


@query("i6_catalog_price",
       "product_id:i base_price:d final_price:d total_savings:d savings_percent:d n_adjustments:i "
       "stock_factor:s ml_factor:d cache_date:s", views=("fx_catalog_active",), oracle=I6_SQL)
def i6(fx):
    """Rule-adjusted catalog price without a model (ML factor 1)."""
    p = pr.catalog_price(_active(fx), as_of_date="2024-01-01")
    stock = F.coalesce(F.try_element_at(F.filter("adjustments", lambda a: a["factor"].isin(
        "Low Stock Premium", "Overstock Discount")), F.lit(1))["factor"], F.lit(""))
    return p.withColumn("n_adjustments", F.size("adjustments")).withColumn("stock_factor", stock)


@query("i6_price_explanation", "product_id:i explanation:s", views=("fx_catalog_active",), oracle=f"""
SELECT product_id, CASE WHEN savings_percent > 0 THEN 'Price reduced by ' || printf('%.1f', savings_percent)
 || '% — ML model + ' || CAST(n_adjustments AS VARCHAR) || ' pricing factors analyzed for today (2024-01-01)'
 WHEN savings_percent < 0 THEN 'Price increased by ' || printf('%.1f', abs(savings_percent))
 || '% — strong demand and premium signals detected for today (2024-01-01)'
 ELSE 'Base price maintained — balanced supply and demand for today (2024-01-01)' END AS explanation
FROM ({I6_SQL})""")
def i6e(fx):
    """The explanation text."""
    return pr.catalog_price(_active(fx), as_of_date="2024-01-01")


# ------------------------------------------------------------------------ I12
@query("i7_daily_prices", "product_id:i cache_date:s final_price:d n_prices:i", views=("fx_catalog_active",), oracle=f"""
SELECT p.product_id, d.cache_date, p.final_price, 1 AS n_prices FROM ({I6_SQL}) p, (VALUES ('2024-01-01'), ('2024-01-02')) AS d(cache_date)""")
def i7(fx):
    """The daily price table of two days, written by day and read back: one price per product and day."""
    from shopsignals.session import tables_dir
    from shopsignals.sources.sinks import write_table

    cat = _active(fx)
    path = f"{tables_dir(cat.sparkSession)}/daily-{uuid.uuid4().hex}"
    for day in ("2024-01-01", "2024-01-02"):
        write_table(pr.daily_prices(cat, day), path, partition_by=["cache_date"], mode="append")
    back = cat.sparkSession.read.parquet(path)
    return (back.groupBy("product_id", F.col("cache_date").cast("string").alias("cache_date"))
            .agg(F.max("final_price").alias("final_price"), F.count(F.lit(1)).alias("n_prices")))


@query("i12_session_wtp", "event_id:i wtp_estimate:d", views=LIVE, oracle=f"SELECT event_id, wtp_estimate FROM ({K3_SQL})")
def i12(fx):
    """Session WTP per event."""
    return ss.session_features_batch(fx("fx_live_clicks"), fx("fx_catalog"))
