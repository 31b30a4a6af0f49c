"""Per-product feature table and price-factor targets.

Plan shape of ``product_features`` at scale:

* the clickstream is aggregated by ``sku_id``: event-type counts (D2),
  statistics with one distinct count (D1) and the segment-weighted WTP (D7) are
  one ``groupBy.agg`` after map-side partial aggregation. D1 alone adds the
  exact median and the distinct sessions, each an aggregate of its own.
* everything after that is per-SKU sized (catalog, competitor aggregates).
* whole-table scalars (median restock days, min/max for normalisation) are
  scalar subqueries — computed once and inlined, never a window over one
  partition and never a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.functions.columns import BATCH_EVENT_TYPES, clip, event_weight
from shopsignals.operators.ranks import median
from shopsignals.session import materialize

_TYPE_COLS = {t: t for t in BATCH_EVENT_TYPES}


# ---------------------------------------------------------------- D1 + D2 + D7
def product_event_stats(clicks: DataFrame, segment_wtp: DataFrame | None = None, full: bool = True) -> DataFrame:
    """D1/D2 (and D7 when ``segment_wtp`` is given).

    ``segment_wtp`` has columns (segment, segment_avg_wtp). ``full=False``
    leaves out the median price and the sessions, which the feature table does
    not use. One distinct count goes with the aggregate (no Expand); the second
    and the median are aggregates of their own.
    """
    ev = clicks.where(F.col("sku_id").isNotNull())
    aggs = [
        F.count("event_id").cast("bigint").alias("total_events"),
        F.sum(event_weight("event_type", "demand")).alias("total_weighted_score"),
        F.avg("price_seen_usd").alias("avg_price_seen"),
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        F.avg("session_duration_s").alias("avg_session_duration"),
        F.avg("scroll_depth_pct").alias("avg_scroll_depth"),
        F.avg("time_on_page_s").alias("avg_time_on_page"),
        F.countDistinct("user_id").cast("bigint").alias("unique_users"),
    ]
    # Fixed pivot values → count_if, no extra job to discover values
    aggs += [F.count_if(F.col("event_type") == F.lit(t)).cast("bigint").alias(t)
             for t in BATCH_EVENT_TYPES]
    if segment_wtp is not None:
        seg = segment_wtp.select(F.col("segment").alias("_seg"), F.col("segment_avg_wtp").alias("_seg_wtp"))
        ev = ev.join(seg, ev["user_segment"] == seg["_seg"], "left")
        has_seg = F.col("user_segment").isNotNull()
        aggs += [
            F.count_if(has_seg).alias("_n_seg"),
            F.count_if(has_seg & F.col("_seg_wtp").isNull()).alias("_n_unmatched"),
            F.sum(F.when(has_seg, F.col("_seg_wtp"))).alias("_sum_wtp"),
        ]
    out = ev.groupBy("sku_id").agg(*aggs)
    if full:
        sessions = (ev.where(F.col("session_id").isNotNull()).select("sku_id", "session_id").distinct()
                    .groupBy("sku_id").agg(F.count(F.lit(1)).alias("unique_sessions")))
        out = (out.join(exact_median(ev, "sku_id", "price_seen_usd", "median_price_seen"), "sku_id", "left")
                  .join(sessions, "sku_id", "left")
                  .withColumn("unique_sessions", F.coalesce("unique_sessions", F.lit(0)).cast("bigint")))
    if segment_wtp is not None:
        # Q3: any unmatched segment (NaN in the reference) → 1.0
        out = out.withColumn(
            "weighted_wtp",
            F.when((F.col("_n_seg") == 0) | (F.col("_n_unmatched") > 0), F.lit(1.0))
            .otherwise(F.col("_sum_wtp") / F.col("_n_seg")),
        ).drop("_n_seg", "_n_unmatched", "_sum_wtp")
    return out


def exact_median(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, out): the exact median of ``value`` per key from counts of equal
    values, so rows are combined before the shuffle and no task buffers a key."""
    c = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)
    c = (c.join(c.groupBy(F.col(key).alias("_k")).agg(F.sum("_n").alias("_all")), F.col(key) == F.col("_k"))
          .withColumn("_upto", F.sum("_n").over(w.orderBy(value))))
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    hit = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value)))
    return c.groupBy(key).agg(((hit(lower) + hit(upper)) / 2).alias(out))


def event_pivot(clicks: DataFrame) -> DataFrame:
    """D2 alone: 9 fixed event-type count columns per SKU, 0 when absent."""
    return (clicks.where(F.col("sku_id").isNotNull()).groupBy("sku_id")
            .agg(*[F.count_if(F.col("event_type") == F.lit(t)).cast("bigint").alias(t)
                   for t in BATCH_EVENT_TYPES]))


# ------------------------------------------------------------------------- D3
def demand_signals(stats: DataFrame) -> DataFrame:
    """D3: views, rates, velocity, log demand, purchase intensity."""
    views = F.col("page_view") + F.col("product_view")
    return (stats
            .withColumn("views", views)
            .withColumn("purchases", F.col("purchase"))
            .withColumn("carts", F.col("add_to_cart"))
            .withColumn("wishlists", F.col("add_to_wishlist"))
            .withColumn("checkouts", F.col("checkout_start"))
            .withColumn("conversion_rate", F.col("purchases") / (F.col("views") + 1))
            .withColumn("cart_rate", F.col("carts") / (F.col("views") + 1))
            .withColumn("wishlist_rate", F.col("wishlists") / (F.col("views") + 1))
            .withColumn("checkout_rate", F.col("checkouts") / (F.col("views") + 1))
            .withColumn("cart_abandon_rate", 1 - F.col("purchases") / (F.col("carts") + 1))
            .withColumn("demand_velocity", F.col("views") + F.col("carts") * 3 + F.col("purchases") * 5)
            .withColumn("log_demand", F.log1p(F.col("demand_velocity")))
            .withColumn("purchase_intensity", F.col("total_quantity") / (F.col("unique_users") + 1)))


# ------------------------------------------------------------------------- B7
def catalog_features(catalog: DataFrame) -> DataFrame:
    """Margin, price range, urgency, stock/restock; restock NULL → median."""
    med = median(catalog, "restock_days")
    restock = F.coalesce(F.col("restock_days").cast("double"), med)
    return (catalog
            .withColumn("restock_days", restock)
            .withColumn("margin", F.try_divide(F.col("base_price_usd") - F.col("cost_price_usd"),
                                               F.col("base_price_usd")))
            .withColumn("price_range", F.col("max_price_usd") - F.col("min_price_usd"))
            # try_divide: a zero denominator (odd inputs) gives NULL, not a failed job
            .withColumn("price_range_pct", F.try_divide(F.col("price_range"), F.col("base_price_usd") + 1))
            .withColumn("inventory_urgency", F.try_divide(F.lit(1.0), F.col("inventory_count") + 1))
            .withColumn("stock_days_ratio", F.try_divide(F.col("inventory_count"), F.col("restock_days") + 1)))


# ------------------------------------------------------------------------- D4
COMP_AGG_COLS = ["comp_avg_price", "comp_min_price", "comp_max_price", "comp_price_std",
                 "comp_records", "avg_price_delta", "promo_rate", "comp_in_stock_rate"]


def competitor_stats(feed: DataFrame) -> DataFrame:
    """Per-SKU competitor aggregates (all algebraic: partial agg map-side)."""
    return (feed.where(F.col("sku_id").isNotNull()).groupBy("sku_id").agg(
        F.avg("competitor_price").alias("comp_avg_price"),
        F.min("competitor_price").alias("comp_min_price"),
        F.max("competitor_price").alias("comp_max_price"),
        F.coalesce(F.stddev_samp("competitor_price"), F.lit(0.0)).alias("comp_price_std"),
        F.count("competitor_price").cast("bigint").alias("comp_records"),
        F.avg("price_delta_pct").alias("avg_price_delta"),
        F.avg(F.col("is_on_promotion").cast("double")).alias("promo_rate"),
        F.avg(F.col("in_stock").cast("double")).alias("comp_in_stock_rate"),
    ))


# ------------------------------------------------------------------ C2 + D5
def with_competitor(df: DataFrame, comp: DataFrame) -> DataFrame:
    """C2 + D5: left join, positioning computed before the fills."""
    j = df.join(comp, "sku_id", "left")
    base = F.col("base_price_usd")
    j = (j.withColumn("price_vs_comp_avg", F.try_divide(base, F.col("comp_avg_price") + 1))
          .withColumn("price_vs_comp_min", F.try_divide(base, F.col("comp_min_price") + 1))
          .withColumn("comp_advantage", F.try_divide(F.col("comp_avg_price") - base, base + 1)))
    fills = {c: 0 for c in COMP_AGG_COLS}
    fills.update({"price_vs_comp_avg": 1.0, "price_vs_comp_min": 1.0, "comp_advantage": 0.0})
    return j.select(*[F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills else F.col(c)
                      for c in j.columns])


# ------------------------------------------------------------------------- D6
def segment_profile(profiles: DataFrame) -> DataFrame:
    """Segment means and counts."""
    return (profiles.where(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.avg("willingness_to_pay_multiplier").alias("segment_avg_wtp"),
        F.avg("lifetime_value_usd").alias("segment_avg_ltv"),
        F.avg("avg_order_value_usd").alias("segment_avg_aov"),
        F.avg("cart_abandonment_rate").alias("segment_cart_abandon"),
        F.avg("purchase_frequency").alias("segment_purchase_freq"),
        F.count("user_id").cast("bigint").alias("segment_count"),
    ))


def product_wtp(clicks: DataFrame, seg: DataFrame) -> DataFrame:
    """D7 on its own: (sku_id, weighted_wtp). Events pre-aggregate per
    (sku, segment) before meeting the segment table."""
    pse = (clicks.where(F.col("sku_id").isNotNull() & F.col("user_segment").isNotNull())
           .groupBy("sku_id", "user_segment").agg(F.count(F.lit(1)).alias("n")))
    s = seg.select("segment", "segment_avg_wtp")
    j = pse.join(s, pse["user_segment"] == s["segment"], "left")
    return (j.groupBy("sku_id").agg(
        F.sum(F.col("n") * F.col("segment_avg_wtp")).alias("_sw"),
        F.sum("n").alias("_n"),
        F.count_if(F.col("segment_avg_wtp").isNull()).alias("_miss"))
        .select("sku_id", F.when(F.col("_miss") > 0, F.lit(1.0))
                .otherwise(F.col("_sw") / F.col("_n")).alias("weighted_wtp")))


def with_wtp(df: DataFrame, wtp: DataFrame) -> DataFrame:
    """C4: left join product WTP, fill 1.0."""
    j = df.drop("weighted_wtp").join(wtp, "sku_id", "left")
    return j.withColumn("weighted_wtp", F.coalesce(F.col("weighted_wtp"), F.lit(1.0)))


# ------------------------------------------------------------------------- E1
def minmax(df: DataFrame, cols: list[str], prefix: str = "norm_",
           names: list[str] | None = None, materialize_input: bool = True) -> DataFrame:
    """Min-max normalise over the whole table; constant column → 0.5.

    The bounds are one scalar subquery (a struct), executed once and inlined.
    The input is materialised first so bounds and rows come from a single
    computation of the upstream plan.
    """
    if materialize_input:
        df = materialize(df)
    names = names or [prefix + c for c in cols]
    fields = []
    for c in cols:
        fields += [F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}")]
    s = df.select(F.struct(*fields).alias("s")).scalar()
    out = df
    for c, n in zip(cols, names):
        mn, mx = s[f"mn_{c}"], s[f"mx_{c}"]
        out = out.withColumn(n, F.when(mx == mn, F.lit(0.5))
                             .otherwise((F.col(c) - mn) / (mx - mn)))
    return out


# ------------------------------------------------------------------------- I9
def price_target(df: DataFrame) -> DataFrame:
    """Composite price factor, business caps, log1p target (order Q4)."""
    norm_src = ["log_demand", "conversion_rate", "cart_rate", "comp_advantage",
                "inventory_urgency", "weighted_wtp", "avg_rating"]
    norm_names = ["norm_demand", "norm_conversion", "norm_cart_rate", "norm_comp_advantage",
                  "norm_inventory_urgency", "norm_wtp", "norm_rating"]
    df = minmax(df, norm_src, names=norm_names)
    n = {k: F.col(k) for k in norm_names}
    factor = (F.lit(1.0) + 0.15 * n["norm_demand"] + 0.10 * n["norm_conversion"]
              + 0.08 * n["norm_cart_rate"] + 0.12 * n["norm_comp_advantage"]
              + 0.10 * n["norm_inventory_urgency"] + 0.08 * n["norm_wtp"]
              + 0.05 * n["norm_rating"] - 0.10 * (1 - n["norm_demand"]))
    pf = clip(factor, 0.70, 1.50)
    adj = F.greatest(F.col("base_price_usd") * pf, F.col("min_price_usd"))
    floor = F.col("cost_price_usd") * 1.05
    adj = F.when(adj < floor, floor).otherwise(adj)
    adj = F.least(adj, F.col("max_price_usd"))
    df = df.withColumn("adjusted_price", adj)
    df = df.withColumn("price_factor",
                       clip(F.try_divide(F.col("adjusted_price"), F.col("base_price_usd")), 0.70, 1.50))
    return df.withColumn("target", F.log1p(F.col("price_factor")))


# ------------------------------------------------------------------------ I11
# Model inputs, table columns and catalog columns.
MODEL_FEATURES = [
    "views", "purchases", "carts", "wishlists", "checkouts", "log_demand",
    "conversion_rate", "cart_rate", "wishlist_rate", "checkout_rate",
    "cart_abandon_rate", "purchase_intensity", "avg_session_duration",
    "avg_scroll_depth", "avg_time_on_page", "unique_users", "base_price_usd",
    "margin", "inventory_count", "restock_days", "inventory_urgency",
    "stock_days_ratio", "avg_rating", "review_count", "price_vs_comp_avg",
    "price_vs_comp_min", "comp_advantage", "comp_price_std", "promo_rate",
    "comp_in_stock_rate", "weighted_wtp",
]

PRICING_COLS = [
    "sku_id", "base_price_usd", "cost_price_usd", "min_price_usd", "max_price_usd",
    "category", "subcategory", "brand", "views", "purchases", "carts", "wishlists",
    "checkouts", "demand_velocity", "log_demand", "conversion_rate", "cart_rate",
    "wishlist_rate", "checkout_rate", "cart_abandon_rate", "purchase_intensity",
    "avg_session_duration", "avg_scroll_depth", "avg_time_on_page", "unique_users",
    "margin", "inventory_count", "restock_days", "inventory_urgency", "stock_days_ratio",
    "avg_rating", "review_count", "comp_avg_price", "comp_min_price", "comp_max_price",
    "price_vs_comp_avg", "price_vs_comp_min", "comp_advantage", "comp_price_std",
    "promo_rate", "comp_in_stock_rate", "weighted_wtp", "price_factor", "adjusted_price",
]

CATALOG_COLS = ["sku_id", "category", "subcategory", "brand", "base_price_usd",
                "cost_price_usd", "current_price_usd", "min_price_usd", "max_price_usd",
                "inventory_count", "restock_days", "avg_rating", "review_count"]


def merged_features(clicks: DataFrame, catalog: DataFrame, feed: DataFrame,
                    profiles: DataFrame) -> DataFrame:
    """Everything up to (not including) the target: D1–D7, B7, C1, C2, C4."""
    seg = segment_profile(profiles)
    stats = demand_signals(product_event_stats(clicks, seg, full=False))
    cat = catalog_features(catalog.select(*CATALOG_COLS))
    merged = stats.join(cat, "sku_id", "inner")                    # C1
    merged = with_competitor(merged, competitor_stats(feed))       # C2 + D5
    return merged.withColumn("weighted_wtp", F.coalesce("weighted_wtp", F.lit(1.0)))  # C4


def product_features(clicks: DataFrame, catalog: DataFrame, feed: DataFrame,
                     profiles: DataFrame, keep_target: bool = False) -> DataFrame:
    """I11 (flagship): one row per SKU with 44 computed columns, sku_id → product_id."""
    merged = merged_features(clicks, catalog, feed, profiles)
    merged = merged.select(*[c for c in PRICING_COLS if c in merged.columns])  # before it is written
    t = price_target(merged)
    cols = PRICING_COLS + (["target"] if keep_target else [])
    # model inputs default to 0 after the target, which a missing value must not move
    return t.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in MODEL_FEATURES else F.col(c) for c in cols]
                    ).withColumnRenamed("sku_id", "product_id")


# ------------------------------------------------------------------------ I10
# The four time scenarios (hour of day, time multiplier).
TIME_SCENARIOS = [(20, 1.10), (14, 1.00), (4, 0.90), (8, 0.98)]


def time_scenarios(features: DataFrame, scenarios=TIME_SCENARIOS) -> DataFrame:
    """I10 (C8, G1): every feature row under each time scenario.

    The scenarios are a literal array exploded per row (a Generate inside the
    same codegen stage): one scan of the feature table, no join, no union.
    """
    arr = F.array(*[F.struct(F.lit(h).alias("hour_of_day"), F.lit(float(m)).alias("time_multiplier"))
                    for h, m in scenarios])
    # normalise before the explode: the bounds are the same, the materialised table 4× smaller
    f = features.withColumn("_lv", F.log1p(F.coalesce(F.col("demand_velocity"), F.lit(0))))
    f = minmax(f, ["_lv"], names=["_nv"])
    x = f.withColumn("_sc", F.explode(arr)).select("*", "_sc.*").drop("_sc")
    inv = F.coalesce(F.col("inventory_count"), F.lit(0))
    factor = (F.col("time_multiplier") + 0.15 * F.col("_nv")
              + 0.10 * clip(F.coalesce(F.col("comp_advantage"), F.lit(0.0)), -0.5, 0.5)
              + 0.10 * F.when(inv < 20, 1.0).otherwise(0.0)
              - 0.05 * F.when(inv > 500, 1.0).otherwise(0.0)
              + 0.05 * (F.coalesce(F.col("weighted_wtp"), F.lit(1.0)) - 1.0))
    x = x.withColumn("target_factor", clip(factor, 0.70, 1.50))
    return x.withColumn("target_log", F.log1p(F.col("target_factor"))).drop("_lv", "_nv")


# ------------------------------------------------------------------ D9 + D10
def coarse_demand(legacy: DataFrame) -> DataFrame:
    """Per-product coarse counts and ratios from the legacy event export."""
    g = (legacy.where(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.count_if(F.col("event_type") == "view").cast("bigint").alias("views"),
        F.count_if(F.col("event_type") == "purchase").cast("bigint").alias("purchases"),
        F.count_if(F.col("event_type") == "cart").cast("bigint").alias("cart"),
        F.avg("price").alias("price")))
    return (g.withColumn("demand", F.col("views") + F.col("purchases") + F.col("cart"))
             .withColumn("conversion_rate", F.col("purchases") / (F.col("views") + 1))
             .withColumn("cart_ratio", F.col("cart") / (F.col("views") + 1))
             .withColumn("log_demand", F.log1p(F.col("demand"))))


def coarse_price_factor(df: DataFrame) -> DataFrame:
    """clip(1 + .5·conv + .3·cart_ratio, .7, 1.5) and its log1p."""
    pf = clip(1 + 0.5 * F.col("conversion_rate") + 0.3 * F.col("cart_ratio"), 0.7, 1.5)
    return df.withColumn("price_factor", pf).withColumn("target", F.log1p(F.col("price_factor")))
