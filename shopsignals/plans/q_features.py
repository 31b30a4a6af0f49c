"""Registered queries: demand features, competitor features, price targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsignals.functions.columns import BATCH_EVENT_TYPES
from shopsignals.operators import features as ft
from shopsignals.operators.catalog import legacy_events
from shopsignals.plans.registry import query

FX4 = ("fx_clickstream", "fx_catalog", "fx_competitor", "fx_profiles")

# ----------------------------------------------------------------- oracle CTEs
_PIVOT_SQL = ", ".join(f"count_if(event_type = '{t}') AS {t}" for t in BATCH_EVENT_TYPES)
_WEIGHT_SQL = ("CASE event_type WHEN 'page_view' THEN 1 WHEN 'product_view' THEN 2 WHEN 'search' THEN 1 "
               "WHEN 'add_to_cart' THEN 4 WHEN 'add_to_wishlist' THEN 3 WHEN 'checkout_start' THEN 5 "
               "WHEN 'purchase' THEN 7 WHEN 'remove_from_cart' THEN -1 WHEN 'page_exit' THEN 0 ELSE 1 END")

STATS_SQL = f"""
SELECT sku_id, count(event_id) AS total_events, sum({_WEIGHT_SQL}) AS total_weighted_score,
 avg(price_seen_usd) AS avg_price_seen, median(price_seen_usd) AS median_price_seen,
 sum(quantity) AS total_quantity, avg(session_duration_s) AS avg_session_duration,
 avg(scroll_depth_pct) AS avg_scroll_depth, avg(time_on_page_s) AS avg_time_on_page,
 count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions, {_PIVOT_SQL}
FROM fx_clickstream WHERE sku_id IS NOT NULL GROUP BY sku_id"""

DEMAND_SQL = f"""
SELECT *, purchases / (views + 1) AS conversion_rate, carts / (views + 1) AS cart_rate,
 wishlists / (views + 1) AS wishlist_rate, checkouts / (views + 1) AS checkout_rate,
 1 - purchases / (carts + 1) AS cart_abandon_rate, views + carts * 3 + purchases * 5 AS demand_velocity,
 ln(1 + views + carts * 3 + purchases * 5) AS log_demand, total_quantity / (unique_users + 1) AS purchase_intensity
FROM (SELECT *, page_view + product_view AS views, purchase AS purchases, add_to_cart AS carts,
 add_to_wishlist AS wishlists, checkout_start AS checkouts FROM ({STATS_SQL}))"""

CATFEAT_SQL = """
SELECT *, (base_price_usd - cost_price_usd) / base_price_usd AS margin,
 max_price_usd - min_price_usd AS price_range, (max_price_usd - min_price_usd) / (base_price_usd + 1) AS price_range_pct,
 1.0 / (inventory_count + 1) AS inventory_urgency, inventory_count / (restock_days + 1) AS stock_days_ratio
FROM (SELECT sku_id, category, subcategory, brand, base_price_usd, cost_price_usd, current_price_usd,
 min_price_usd, max_price_usd, inventory_count, avg_rating, review_count,
 coalesce(CAST(restock_days AS DOUBLE), (SELECT median(restock_days) FROM fx_catalog)) AS restock_days
 FROM fx_catalog)"""

COMP_SQL = """
SELECT sku_id, avg(competitor_price) AS comp_avg_price, min(competitor_price) AS comp_min_price,
 max(competitor_price) AS comp_max_price, coalesce(stddev_samp(competitor_price), 0) AS comp_price_std,
 count(competitor_price) AS comp_records, avg(price_delta_pct) AS avg_price_delta,
 avg(CAST(is_on_promotion AS DOUBLE)) AS promo_rate, avg(CAST(in_stock AS DOUBLE)) AS comp_in_stock_rate
FROM fx_competitor WHERE sku_id IS NOT NULL GROUP BY sku_id"""

SEG_SQL = """
SELECT segment, avg(willingness_to_pay_multiplier) AS segment_avg_wtp, avg(lifetime_value_usd) AS segment_avg_ltv,
 avg(avg_order_value_usd) AS segment_avg_aov, avg(cart_abandonment_rate) AS segment_cart_abandon,
 avg(purchase_frequency) AS segment_purchase_freq, count(user_id) AS segment_count
FROM fx_profiles WHERE segment IS NOT NULL GROUP BY segment"""

WTP_SQL = f"""
SELECT sku_id, CASE WHEN count_if(s.segment_avg_wtp IS NULL) > 0 THEN 1.0
 ELSE sum(n * s.segment_avg_wtp) / sum(n) END AS weighted_wtp
FROM (SELECT sku_id, user_segment, count(*) AS n FROM fx_clickstream
      WHERE sku_id IS NOT NULL AND user_segment IS NOT NULL GROUP BY sku_id, user_segment) p
LEFT JOIN ({SEG_SQL}) s ON p.user_segment = s.segment GROUP BY sku_id"""

MERGED_SQL = f"""
SELECT d.*, c.category, c.subcategory, c.brand, c.base_price_usd, c.cost_price_usd, c.current_price_usd,
 c.min_price_usd, c.max_price_usd, c.inventory_count, c.avg_rating, c.review_count, c.restock_days,
 c.margin, c.price_range, c.price_range_pct, c.inventory_urgency, c.stock_days_ratio,
 coalesce(k.comp_avg_price, 0) AS comp_avg_price, coalesce(k.comp_min_price, 0) AS comp_min_price,
 coalesce(k.comp_max_price, 0) AS comp_max_price, coalesce(k.comp_price_std, 0) AS comp_price_std,
 coalesce(k.comp_records, 0) AS comp_records, coalesce(k.avg_price_delta, 0) AS avg_price_delta,
 coalesce(k.promo_rate, 0) AS promo_rate, coalesce(k.comp_in_stock_rate, 0) AS comp_in_stock_rate,
 coalesce(c.base_price_usd / (k.comp_avg_price + 1), 1.0) AS price_vs_comp_avg,
 coalesce(c.base_price_usd / (k.comp_min_price + 1), 1.0) AS price_vs_comp_min,
 coalesce((k.comp_avg_price - c.base_price_usd) / (c.base_price_usd + 1), 0.0) AS comp_advantage,
 coalesce(w.weighted_wtp, 1.0) AS weighted_wtp
FROM ({DEMAND_SQL}) d JOIN ({CATFEAT_SQL}) c ON d.sku_id = c.sku_id
LEFT JOIN ({COMP_SQL}) k ON d.sku_id = k.sku_id LEFT JOIN ({WTP_SQL}) w ON d.sku_id = w.sku_id"""


def _norm(col, name):
    return (f"CASE WHEN b.mx_{name} = b.mn_{name} THEN 0.5 "
            f"ELSE ({col} - b.mn_{name}) / (b.mx_{name} - b.mn_{name}) END AS {name}")


_NORMS = [("log_demand", "norm_demand"), ("conversion_rate", "norm_conversion"),
          ("cart_rate", "norm_cart_rate"), ("comp_advantage", "norm_comp_advantage"),
          ("inventory_urgency", "norm_inventory_urgency"), ("weighted_wtp", "norm_wtp"),
          ("avg_rating", "norm_rating")]

TARGET_SQL = f"""
SELECT *, least(greatest(adjusted_price / base_price_usd, 0.7), 1.5) AS price_factor,
 ln(1 + least(greatest(adjusted_price / base_price_usd, 0.7), 1.5)) AS target
FROM (SELECT *, least(CASE WHEN a0 < cost_price_usd * 1.05 THEN cost_price_usd * 1.05 ELSE a0 END, max_price_usd) AS adjusted_price
 FROM (SELECT *, greatest(base_price_usd * least(greatest(1.0 + 0.15 * norm_demand + 0.10 * norm_conversion
   + 0.08 * norm_cart_rate + 0.12 * norm_comp_advantage + 0.10 * norm_inventory_urgency + 0.08 * norm_wtp
   + 0.05 * norm_rating - 0.10 * (1 - norm_demand), 0.7), 1.5), min_price_usd) AS a0
  FROM (SELECT m.*, {", ".join(_norm(c, n) for c, n in _NORMS)}
   FROM ({MERGED_SQL}) m,
   (SELECT {", ".join(f"min({c}) AS mn_{n}, max({c}) AS mx_{n}" for c, n in _NORMS)} FROM ({MERGED_SQL})) b)))"""

# the table's model inputs default to 0 once the target is built
FEATURES_SQL = f"""
SELECT * REPLACE ({", ".join(f"coalesce({c}, 0) AS {c}" for c in ft.MODEL_FEATURES)}), sku_id AS product_id FROM ({TARGET_SQL})"""

I11_OUT = ("product_id:i base_price_usd:d cost_price_usd:d min_price_usd:d max_price_usd:d "
           "category:s subcategory:s brand:s views:i purchases:i carts:i wishlists:i checkouts:i "
           "demand_velocity:i log_demand:d conversion_rate:d cart_rate:d wishlist_rate:d checkout_rate:d "
           "cart_abandon_rate:d purchase_intensity:d avg_session_duration:d avg_scroll_depth:d "
           "avg_time_on_page:d unique_users:i margin:d inventory_count:i restock_days:d "
           "inventory_urgency:d stock_days_ratio:d avg_rating:d review_count:i comp_avg_price:d "
           "comp_min_price:d comp_max_price:d price_vs_comp_avg:d price_vs_comp_min:d comp_advantage:d "
           "comp_price_std:d promo_rate:d comp_in_stock_rate:d weighted_wtp:d price_factor:d adjusted_price:d")


@query("i11_product_features", I11_OUT, views=FX4,
       oracle=FEATURES_SQL)
def i11(fx):
    """I11 flagship: the per-product pricing feature table."""
    return ft.product_features(fx("fx_clickstream"), fx("fx_catalog"),
                               fx("fx_competitor"), fx("fx_profiles"))


_STATS_OUT = ("sku_id:i total_events:i total_weighted_score:d avg_price_seen:d median_price_seen:d "
              "total_quantity:i avg_session_duration:d avg_scroll_depth:d avg_time_on_page:d "
              "unique_users:i unique_sessions:i " + " ".join(f"{t}:i" for t in BATCH_EVENT_TYPES))


@query("d1_product_event_stats", _STATS_OUT, views=("fx_clickstream",), oracle=STATS_SQL)
def d1(fx):
    """D1 + D2: per-product event statistics with the 9-way event pivot."""
    return ft.product_event_stats(fx("fx_clickstream"))


@query("d2_event_pivot", "sku_id:i " + " ".join(f"{t}:i" for t in BATCH_EVENT_TYPES),
       views=("fx_clickstream",),
       oracle=f"SELECT sku_id, {_PIVOT_SQL} FROM fx_clickstream WHERE sku_id IS NOT NULL GROUP BY sku_id")
def d2(fx):
    """Event-type pivot."""
    return ft.event_pivot(fx("fx_clickstream"))


@query("d3_demand_signals",
       "sku_id:i views:i purchases:i carts:i wishlists:i checkouts:i conversion_rate:d cart_rate:d "
       "wishlist_rate:d checkout_rate:d cart_abandon_rate:d demand_velocity:i log_demand:d purchase_intensity:d",
       views=("fx_clickstream",), oracle=DEMAND_SQL)
def d3(fx):
    """D3: demand velocity and conversion signals."""
    return ft.demand_signals(ft.product_event_stats(fx("fx_clickstream")))


@query("b7_catalog_features",
       "sku_id:i restock_days:d margin:d price_range:d price_range_pct:d inventory_urgency:d stock_days_ratio:d",
       views=("fx_catalog",), oracle=CATFEAT_SQL)
def b7(fx):
    """Catalog price features with median-filled restock days."""
    return ft.catalog_features(fx("fx_catalog"))


@query("d4_competitor_stats",
       "sku_id:i comp_avg_price:d comp_min_price:d comp_max_price:d comp_price_std:d comp_records:i "
       "avg_price_delta:d promo_rate:d comp_in_stock_rate:d",
       views=("fx_competitor",), oracle=COMP_SQL)
def d4(fx):
    """Competitor aggregates per SKU."""
    return ft.competitor_stats(fx("fx_competitor"))


@query("d5_competitor_position",
       "sku_id:i base_price_usd:d comp_avg_price:d comp_min_price:d comp_records:i price_vs_comp_avg:d "
       "price_vs_comp_min:d comp_advantage:d",
       views=("fx_catalog", "fx_competitor"),
       oracle="""
SELECT c.sku_id, c.base_price_usd, coalesce(k.comp_avg_price, 0) AS comp_avg_price,
 coalesce(k.comp_min_price, 0) AS comp_min_price, coalesce(k.comp_records, 0) AS comp_records,
 coalesce(c.base_price_usd / (k.comp_avg_price + 1), 1.0) AS price_vs_comp_avg,
 coalesce(c.base_price_usd / (k.comp_min_price + 1), 1.0) AS price_vs_comp_min,
 coalesce((k.comp_avg_price - c.base_price_usd) / (c.base_price_usd + 1), 0.0) AS comp_advantage
FROM fx_catalog c LEFT JOIN (""" + COMP_SQL + ") k ON c.sku_id = k.sku_id")
def d5(fx):
    """C2 + D5: catalog ⟕ competitor aggregates with positioning and fills."""
    cat = fx("fx_catalog").select("sku_id", "base_price_usd")
    return ft.with_competitor(cat, ft.competitor_stats(fx("fx_competitor")))


@query("d6_segment_profile",
       "segment:s segment_avg_wtp:d segment_avg_ltv:d segment_avg_aov:d segment_cart_abandon:d "
       "segment_purchase_freq:d segment_count:i", views=("fx_profiles",), oracle=SEG_SQL)
def d6(fx):
    """User segment profile."""
    return ft.segment_profile(fx("fx_profiles"))


@query("d7_product_wtp", "sku_id:i weighted_wtp:d", views=("fx_clickstream", "fx_profiles"),
       oracle=WTP_SQL)
def d7(fx):
    """Event-weighted willingness to pay per product."""
    return ft.product_wtp(fx("fx_clickstream"), ft.segment_profile(fx("fx_profiles")))


@query("c4_with_wtp", "sku_id:i weighted_wtp:d", views=("fx_clickstream", "fx_profiles", "fx_catalog"),
       oracle=f"SELECT c.sku_id, coalesce(w.weighted_wtp, 1.0) AS weighted_wtp FROM fx_catalog c "
              f"LEFT JOIN ({WTP_SQL}) w ON c.sku_id = w.sku_id")
def c4(fx):
    """C3 + C4: catalog ⟕ product WTP with the 1.0 fill."""
    w = ft.product_wtp(fx("fx_clickstream"), ft.segment_profile(fx("fx_profiles")))
    return ft.with_wtp(fx("fx_catalog").select("sku_id"), w)


@query("e1_minmax", "sku_id:i norm_rating:d norm_inventory:d norm_const:d", views=("fx_catalog",),
       oracle="""
SELECT sku_id, CASE WHEN b.b1 = b.a1 THEN 0.5 ELSE (avg_rating - b.a1) / (b.b1 - b.a1) END AS norm_rating,
 CASE WHEN b.b2 = b.a2 THEN 0.5 ELSE (inventory_count - b.a2) / (b.b2 - b.a2) END AS norm_inventory,
 0.5 AS norm_const
FROM fx_catalog, (SELECT min(avg_rating) AS a1, max(avg_rating) AS b1, min(inventory_count) AS a2,
 max(inventory_count) AS b2 FROM fx_catalog) b""")
def e1(fx):
    """Min-max normalisation; a constant column maps to 0.5."""
    df = fx("fx_catalog").withColumn("const", F.lit(3.0))
    return ft.minmax(df, ["avg_rating", "inventory_count", "const"],
                     names=["norm_rating", "norm_inventory", "norm_const"])


@query("i9_price_target",
       "sku_id:i norm_demand:d norm_comp_advantage:d norm_wtp:d price_factor:d adjusted_price:d target:d",
       views=FX4, oracle=TARGET_SQL)
def i9(fx):
    """Price-factor target on the merged feature table."""
    m = ft.merged_features(fx("fx_clickstream"), fx("fx_catalog"), fx("fx_competitor"), fx("fx_profiles"))
    return ft.price_target(m)


@query("i10_time_scenarios",
       "product_id:i hour_of_day:i time_multiplier:d target_factor:d target_log:d",
       views=FX4 + ("fx_time_scenarios",),
       oracle=f"""
SELECT p.product_id, s.hour_of_day, s.time_multiplier,
 least(greatest(s.time_multiplier
  + 0.15 * CASE WHEN b.mx = b.mn THEN 0.5 ELSE (ln(1 + p.demand_velocity) - b.mn) / (b.mx - b.mn) END
  + 0.10 * least(greatest(p.comp_advantage, -0.5), 0.5)
  + 0.10 * CASE WHEN p.inventory_count < 20 THEN 1.0 ELSE 0.0 END
  - 0.05 * CASE WHEN p.inventory_count > 500 THEN 1.0 ELSE 0.0 END
  + 0.05 * (p.weighted_wtp - 1.0), 0.7), 1.5) AS target_factor,
 ln(1 + least(greatest(s.time_multiplier
  + 0.15 * CASE WHEN b.mx = b.mn THEN 0.5 ELSE (ln(1 + p.demand_velocity) - b.mn) / (b.mx - b.mn) END
  + 0.10 * least(greatest(p.comp_advantage, -0.5), 0.5)
  + 0.10 * CASE WHEN p.inventory_count < 20 THEN 1.0 ELSE 0.0 END
  - 0.05 * CASE WHEN p.inventory_count > 500 THEN 1.0 ELSE 0.0 END
  + 0.05 * (p.weighted_wtp - 1.0), 0.7), 1.5)) AS target_log
FROM ({FEATURES_SQL}) p CROSS JOIN fx_time_scenarios s,
 (SELECT min(ln(1 + demand_velocity)) AS mn, max(ln(1 + demand_velocity)) AS mx FROM ({TARGET_SQL})) b""")
def i10(fx):
    """Time-scenario targets over the product feature table."""
    p = ft.product_features(fx("fx_clickstream"), fx("fx_catalog"), fx("fx_competitor"), fx("fx_profiles"))
    return ft.time_scenarios(p)


_LEGACY_SQL = """
SELECT e.sku_id AS product_id, e.user_id, CASE e.event_type WHEN 'page_view' THEN 'view' WHEN 'product_view' THEN 'view'
 WHEN 'search' THEN 'view' WHEN 'add_to_cart' THEN 'cart' WHEN 'add_to_wishlist' THEN 'cart'
 WHEN 'checkout_start' THEN 'cart' WHEN 'purchase' THEN 'purchase' ELSE 'view' END AS event_type,
 e.price_seen_usd AS price
FROM fx_clickstream e"""


@query("d9_coarse_demand",
       "product_id:i views:i purchases:i cart:i price:d demand:i conversion_rate:d cart_ratio:d "
       "log_demand:d price_factor:d target:d",
       views=("fx_clickstream", "fx_catalog"), oracle=f"""
SELECT *, least(greatest(1 + 0.5 * conversion_rate + 0.3 * cart_ratio, 0.7), 1.5) AS price_factor,
 ln(1 + least(greatest(1 + 0.5 * conversion_rate + 0.3 * cart_ratio, 0.7), 1.5)) AS target
FROM (SELECT *, views + purchases + cart AS demand, purchases / (views + 1) AS conversion_rate,
 cart / (views + 1) AS cart_ratio, ln(1 + views + purchases + cart) AS log_demand
 FROM (SELECT product_id, count_if(event_type = 'view') AS views, count_if(event_type = 'purchase') AS purchases,
  count_if(event_type = 'cart') AS cart, avg(price) AS price FROM ({_LEGACY_SQL}) WHERE product_id IS NOT NULL
  GROUP BY product_id))""")
def d9(fx):
    """D9 + D10: coarse demand and price factor from the legacy export."""
    leg = legacy_events(fx("fx_clickstream"), fx("fx_catalog"))
    return ft.coarse_price_factor(ft.coarse_demand(leg))
