"""Price decisions (I1–I8, I12, C12). Column expressions over joined inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.functions.columns import clip, round_to

# Fixed values of the live pricing rules.
MIN_MARGIN_PCT = 0.10
MAX_DISCOUNT_PCT = 0.30
MAX_PREMIUM_PCT = 0.20
REASON_FLOOR = "Minimum margin floor applied"
REASON_DISCOUNT_CAP = "Discount capped at 30%"
REASON_PREMIUM_CAP = "Premium capped at 20%"
REASON_INTENT = "Price adjusted based on high purchase intent in your session"
REASON_ENGAGEMENT = "Personalised price based on your browsing activity"
REASON_DISCOUNT = "You're getting a %d%% discount — demand is lower right now"
REASON_PREMIUM = "Price slightly higher due to current high demand"
REASON_DEFAULT = "Competitive price based on current market conditions"
# defaults when a session has no features yet
DEFAULT_INTENT, DEFAULT_ENGAGEMENT, DEFAULT_WTP = 0.05, 0.1, 0.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------------- I1
def session_price_expr(base, intent, engagement, wtp, comp_min) -> Column:
    """I1 heuristic session price (rounded to 2)."""
    base, intent, engagement, wtp, comp_min = map(_c, (base, intent, engagement, wtp, comp_min))
    signal = 0.6 * intent + 0.4 * engagement
    mult = 1.0 + (signal - 0.3) * 0.15
    ratio = F.try_divide(base, comp_min)
    has_comp = comp_min.isNotNull() & (comp_min > 0)
    mult = (F.when(has_comp & (ratio > 1.05), mult * 0.97)
             .when(has_comp & (ratio < 0.90), mult * 1.02).otherwise(mult))
    has_wtp = wtp.isNotNull() & (wtp > 0)
    mult = F.when(has_wtp, 0.7 * mult + 0.3 * F.try_divide(wtp, base)).otherwise(mult)
    return round_to(base * mult, 2)


def session_price(df: DataFrame, base="base_price", intent="intent_probability",
                  engagement="engagement_score", wtp="wtp_estimate", comp_min="competitor_min") -> DataFrame:
    return df.withColumn("raw_price", session_price_expr(base, intent, engagement, wtp, comp_min))


# ------------------------------------------------------------------------- I2
def apply_price_rules(df: DataFrame, raw="raw_price", base="base_price") -> DataFrame:
    """Floor / discount cap / premium cap, with the rule reason."""
    r, b = _c(raw), _c(base)
    floor, lo, hi = b * MIN_MARGIN_PCT, b * (1 - MAX_DISCOUNT_PCT), b * (1 + MAX_PREMIUM_PCT)
    price = (F.when(r < floor, round_to(floor, 2)).when(r < lo, round_to(lo, 2))
              .when(r > hi, round_to(hi, 2)).otherwise(round_to(r, 2)))
    reason = (F.when(r < floor, F.lit(REASON_FLOOR)).when(r < lo, F.lit(REASON_DISCOUNT_CAP))
               .when(r > hi, F.lit(REASON_PREMIUM_CAP)).otherwise(F.lit("")))
    return df.withColumn("final_price", price).withColumn("rule_reason", reason)


# ------------------------------------------------------------------------- I3
def price_reason(df: DataFrame, final="final_price", base="base_price",
                 intent="intent_probability", engagement="engagement_score",
                 rule="rule_reason") -> DataFrame:
    """First matching reason text; the percentage is truncated like int()."""
    f, b, i, e, rr = map(_c, (final, base, intent, engagement, rule))
    disc = F.try_divide(b - f, b)
    pct = F.floor(disc * 100).cast("bigint")
    reason = (F.when(F.coalesce(rr, F.lit("")) != "", rr)
               .when(i > 0.6, F.lit(REASON_INTENT))
               .when(e > 0.7, F.lit(REASON_ENGAGEMENT))
               .when(disc > 0.15, F.format_string(REASON_DISCOUNT, pct))
               .when(f > b, F.lit(REASON_PREMIUM))
               .otherwise(F.lit(REASON_DEFAULT)))
    return df.withColumn("reason", reason)


def discount_pct(final, base) -> Column:
    return round_to(F.try_divide(_c(base) - _c(final), _c(base)) * 100, 1)


# ------------------------------------------------------------------------- I4
def price_requests(req: DataFrame, products: DataFrame, features: DataFrame,
                   competitor: DataFrame) -> DataFrame:
    """I4: price a batch of (product_id, user_id, session_id) requests.

    products: (product_id, base_price); features: latest per session
    (session_id, intent_probability, engagement_score, wtp_estimate);
    competitor: (product_id, min). Requests for unknown products drop out
    (the reference answers 404), as do those with an empty product, user or
    session id (400). All three lookups are equi-joins on keys. ``variant``
    defaults to A. The price that a repeated request gets from the cache is
    ``serve_cached``.
    """
    for c in ("product_id", "user_id", "session_id"):
        if c in req.columns:
            req = req.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    f = features.select("session_id", "intent_probability", "engagement_score", "wtp_estimate")
    c = competitor.select("product_id", F.col("min").alias("competitor_min"))
    j = (req.join(products.select("product_id", "base_price"), "product_id", "inner")
            .join(f, "session_id", "left").join(c, "product_id", "left"))
    return decide_prices(j)


def decide_prices(j: DataFrame) -> DataFrame:
    """I4 after the lookups: requests with base_price, competitor_min and the
    session's features (null: defaults) -> price, reason, variant, discount."""
    j = (j.withColumn("intent_probability", F.coalesce("intent_probability", F.lit(DEFAULT_INTENT)))
          .withColumn("engagement_score", F.coalesce("engagement_score", F.lit(DEFAULT_ENGAGEMENT)))
          .withColumn("wtp_estimate", F.coalesce("wtp_estimate", F.lit(DEFAULT_WTP))))
    j = price_reason(apply_price_rules(session_price(j)))
    j = j.withColumn("variant", F.coalesce("variant", F.lit("A")) if "variant" in j.columns else F.lit("A"))
    return j.withColumn("discount_pct", discount_pct("final_price", "base_price"))


def serve_cached(priced: DataFrame, ttl_seconds: int = 60, order=("timestamp", "event_id")) -> DataFrame:
    """I4: ``priced`` requests as the service answers them in ``order``, with
    ``cache_hit``. A request less than ``ttl_seconds`` after the last price
    computed for its product and user gets that price and reason again; a hit
    does not prolong the entry. A request without a time is computed, for itself.

    Whether a request is computed depends on all before it. Its successor is the
    first request at least the time to live later; the computed requests are the
    first one after each pause over the time to live, and the successors of
    computed ones. These chains are followed by doubling: successors of 1, 2, 4 ..
    steps are tables, joined from the longest down, so a stretch without a pause
    costs a number of joins that grows with the logarithm of its length, each
    spread over all tasks by request. Time is cut into slots of one time to live:
    a successor is in the next two slots, and a slot holds at most one computed
    request of a product and user, so that no step sees more than the requests of
    one product and user in one slot together.
    """
    from shopsignals.operators.sessions import _gap_clock, _positions
    from shopsignals.session import materialize

    ttl = int(ttl_seconds) * 1_000_000
    priced = materialize(priced)  # read for the range split's sample, its rows and the requests without a time
    pair = F.struct("product_id", "user_id")
    timed = priced.withColumn("_pair", pair).withColumn("_us", _gap_clock(order[0]))
    cut = _positions(timed.where("_us is not null"), "_pair", order, ttl_seconds, order[0])
    rows = materialize(cut.withColumn("_slot", F.floor(F.col("_us") / ttl)))
    ids = rows.select("_pair", "_start", "_pos", "_us", "_slot")
    spans = (ids.groupBy("_pair", "_start").agg((F.max("_us") - F.min("_us")).alias("_span")).where(F.col("_span") >= ttl)
             .select("_pair", "_start"))
    steps = [materialize(_successors(ids.join(spans, ["_pair", "_start"], "left_semi"), ttl))]
    while not steps[-1].isEmpty():
        again = steps[-1].select("_pair", F.col("_pos").alias("_next"), F.col("_next").alias("_pos2"))
        steps.append(materialize(steps[-1].join(again, ["_pair", "_next"]).select("_pair", "_pos", F.col("_pos2").alias("_next"))))
    reached = spans.select("_pair", F.col("_start").alias("_pos"))
    for step in reversed(steps[:-1]):
        on = reached.join(step, ["_pair", "_pos"]).select("_pair", F.col("_next").alias("_pos"))
        reached = materialize(reached.unionByName(on))
    computed = reached.unionByName(ids.select("_pair", F.col("_start").alias("_pos")).distinct()).distinct()
    kept = rows.select("_pair", "_pos", "_slot", "final_price", "reason").join(computed, ["_pair", "_pos"], "left_semi")
    kept = materialize(kept.select("_pair", "_slot", F.struct("_pos", "final_price", "reason").alias("_s")))
    # the price in force was computed in the request's own slot, at or before it, or in the slot before
    out = rows.join(kept.withColumnRenamed("_s", "_own"), ["_pair", "_slot"], "left")
    late = kept.select("_pair", (F.col("_slot") + 1).alias("_slot"), F.col("_s").alias("_before"))
    out = out.join(late, ["_pair", "_slot"], "left")
    used = F.when(F.col("_own._pos") <= F.col("_pos"), F.col("_own")).otherwise(F.col("_before"))
    out = out.withColumn("_used", used).withColumn("cache_hit", F.col("_used._pos") < F.col("_pos"))
    answer = {"final_price": F.col("_used.final_price"), "reason": F.col("_used.reason")}
    out = out.select(*[answer.get(c, F.col(c)).alias(c) for c in priced.columns], "cache_hit")
    out = out.unionByName(timed.where("_us is null").select(*priced.columns, F.lit(False).alias("cache_hit")))
    return out.withColumn("discount_pct", discount_pct("final_price", "base_price"))


def _successors(ids: DataFrame, ttl: int) -> DataFrame:
    """(_pair, _pos, _next): the first request of the stretch at least ``ttl``
    microseconds after each, where there is one. As no pause in a stretch is longer
    it lies in the next slot, or is the first of the slot after that."""
    group = ["_pair", "_start", "_slot"]
    events = ids.select(*group, "_us", F.col("_pos").alias("_event"), F.lit(None).cast("long").alias("_asks"))
    asks = ids.select("_pair", "_start", (F.col("_slot") + 1).alias("_slot"), (F.col("_us") + ttl).alias("_us"),
                      F.lit(None).cast("long").alias("_event"), F.col("_pos").alias("_asks"))
    # from the slot's end backwards; at equal times an event counts for the request that asks
    later = Window.partitionBy(*group).orderBy(F.desc("_us"), F.desc_nulls_last("_event")).rowsBetween(Window.unboundedPreceding, 0)
    found = events.unionByName(asks).withColumn("_next", F.min("_event").over(later)).where("_asks is not null")
    first = ids.groupBy("_pair", "_start", (F.col("_slot") - 1).alias("_slot")).agg(F.min("_pos").alias("_after"))
    return (found.join(first, group, "left").select("_pair", F.col("_asks").alias("_pos"), F.coalesce("_next", "_after").alias("_next"))
            .where("_next is not null"))


# ------------------------------------------------------------------------- I5
def explain_prices(req: DataFrame, products: DataFrame, log: DataFrame, features: DataFrame,
                   competitor: DataFrame, as_of, ttl_seconds: int = 60) -> DataFrame:
    """Explanation view per (product_id, user_id, session_id) request.

    "Cached" = the newest pricing-log row of (product, user) logged less than
    ``ttl_seconds`` before ``as_of``; otherwise the base price applies.
    """
    as_of = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    fresh = log.where((F.col("timestamp").cast("timestamp") <= as_of) &
                      (F.col("timestamp").cast("timestamp") > as_of - F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")))
    latest = (fresh.groupBy("product_id", "user_id")
              .agg(F.max_by(F.struct("final_price", "reason"), F.struct("timestamp", "final_price", "reason"))
                   .alias("_c"))
              .select("product_id", "user_id", F.col("_c.final_price").alias("cached_price"),
                      F.col("_c.reason").alias("cached_reason")))
    f = features.select("session_id", "intent_probability", "engagement_score", "wtp_estimate",
                        "session_length", "last_event_type")
    c = competitor.select("product_id", F.col("min").alias("competitor_min"))
    j = (req.join(products.select("product_id", "product_name", "base_price"), "product_id", "inner")
            .join(latest, ["product_id", "user_id"], "left")
            .join(f, "session_id", "left").join(c, "product_id", "left"))
    your = F.coalesce(F.col("cached_price"), F.col("base_price"))
    keep = [c for c in req.columns if c not in ("product_id", "user_id", "session_id")]
    return j.select(
        *keep, "product_id", "user_id", "session_id", "product_name", "base_price",
        your.alias("your_price"), discount_pct(your, F.col("base_price")).alias("discount_pct"),
        F.coalesce("cached_reason", F.lit("Standard pricing")).alias("reason"),
        F.coalesce("intent_probability", F.lit(DEFAULT_INTENT)).alias("intent_probability"),
        F.coalesce("engagement_score", F.lit(DEFAULT_ENGAGEMENT)).alias("engagement_score"),
        F.coalesce("wtp_estimate", F.lit(DEFAULT_WTP)).alias("wtp_estimate"),
        F.coalesce("session_length", F.lit(0)).cast("bigint").alias("session_length"),
        F.coalesce("last_event_type", F.lit("page_view")).alias("last_event"),
        "competitor_min", F.col("cached_price").isNotNull().alias("is_cached"))


# ------------------------------------------------------------------------- I6
def catalog_price(catalog: DataFrame, predictions: DataFrame | None = None,
                  as_of_date: str | None = None) -> DataFrame:
    """Daily catalog price = ML factor × stock and rating adjustments.

    ``predictions`` (sku_id, predicted_price) comes from a price model
    (J5/I8); without it the factor is 1, as when the reference has no model.
    The price ignores the user entirely (rule Q8).
    """
    df = catalog
    if predictions is not None:
        df = df.join(predictions.select("sku_id", "predicted_price"), "sku_id", "left")
    else:
        df = df.withColumn("predicted_price", F.lit(None).cast("double"))
    base = F.coalesce(F.col("base_price_usd"), F.lit(0.0))
    cur = F.coalesce(F.col("current_price_usd"), base)
    inv = F.coalesce(F.col("inventory_count"), F.lit(0))
    rating = F.coalesce(F.col("avg_rating"), F.lit(0.0))
    reviews = F.coalesce(F.col("review_count"), F.lit(0))
    pred = F.coalesce(F.col("predicted_price"), cur)
    ml = clip(F.when(cur > 0, pred / cur).otherwise(F.lit(1.0)), 0.7, 1.5)
    inv_adj = F.when(inv < 20, 1.08).when(inv > 500, 0.95).otherwise(1.0)
    rate_adj = (F.when((rating >= 4.5) & (reviews > 100), 1.05)
                 .when((rating < 2.5) & (reviews > 20), 0.92).otherwise(1.0))
    final = round_to(F.greatest(cur * ml * inv_adj * rate_adj, base * 0.70), 2)
    adjustments = F.filter(F.array(
        F.struct(F.lit("ML Price Model").alias("factor"),
                 F.concat(F.lit(""), F.when(ml >= 1, F.lit("+")).otherwise(F.lit("")),
                          F.format_string("%.1f", round_to((ml - 1) * 100, 1)), F.lit("%")).alias("impact")),
        F.when(inv < 20, F.struct(F.lit("Low Stock Premium").alias("factor"), F.lit("+8%").alias("impact")))
         .when(inv > 500, F.struct(F.lit("Overstock Discount").alias("factor"), F.lit("-5%").alias("impact"))),
        F.when((rating >= 4.5) & (reviews > 100),
               F.struct(F.lit("Premium Rating").alias("factor"), F.lit("+5%").alias("impact")))
         .when((rating < 2.5) & (reviews > 20),
               F.struct(F.lit("Rating Discount").alias("factor"), F.lit("-8%").alias("impact"))),
    ), lambda x: x.isNotNull())
    out = (df.withColumn("ml_factor", ml).withColumn("final_price", final)
             .withColumn("cur_price", cur)
             .withColumn("total_savings", round_to(F.col("cur_price") - F.col("final_price"), 2))
             .withColumn("savings_percent",
                         F.when(F.col("cur_price") > 0,
                                round_to(F.col("total_savings") / F.col("cur_price") * 100, 1))
                         .otherwise(F.lit(0.0)))
             .withColumn("adjustments", adjustments))
    day = F.lit(as_of_date) if as_of_date else F.current_date().cast("string")
    n = F.size("adjustments")
    pct = F.format_string("%.1f", F.abs(F.col("savings_percent")))
    expl = (F.when(F.col("savings_percent") > 0,
                   F.concat(F.lit("Price reduced by "), pct, F.lit("% — ML model + "), n.cast("string"),
                            F.lit(" pricing factors analyzed for today ("), day, F.lit(")")))
             .when(F.col("savings_percent") < 0,
                   F.concat(F.lit("Price increased by "), pct,
                            F.lit("% — strong demand and premium signals detected for today ("), day, F.lit(")")))
             .otherwise(F.concat(F.lit("Base price maintained — balanced supply and demand for today ("),
                                 day, F.lit(")"))))
    return out.select(
        F.col("sku_id").alias("product_id"), round_to(F.col("cur_price"), 2).alias("base_price"),
        "final_price", "total_savings", "savings_percent", expl.alias("explanation"), "adjustments",
        F.lit("anonymous").alias("user_segment"), inv.alias("inventory"), rating.alias("avg_rating"),
        reviews.alias("review_count"), round_to(F.col("ml_factor"), 4).alias("ml_factor"),
        day.alias("cache_date"))


# ------------------------------------------------------------------------- I7
def daily_prices(catalog: DataFrame, date: str, predictions: DataFrame | None = None) -> DataFrame:
    """The per-day price table (write with ``partition_by=['cache_date']``)."""
    return catalog_price(catalog, predictions, as_of_date=date)


# ------------------------------------------------------------------------ I12
def session_wtp_expr(base, intent) -> Column:
    """base·(0.70 + 0.40·intent) rounded to 2; 0 when the SKU is unknown."""
    return F.when(_c(base).isNull(), F.lit(0.0)).otherwise(round_to(_c(base) * (0.70 + _c(intent) * 0.40), 2))


# ------------------------------------------------------------------------ C12
def competitor_or_seed(live: DataFrame, seed: DataFrame) -> DataFrame:
    """Live competitor min/max where present, else the seeded price.

    live: (product_id, min, max); seed: (product_id, seed_price).
    """
    j = seed.join(live, "product_id", "left")
    return j.select("product_id",
                    F.coalesce(F.col("min"), F.col("seed_price")).alias("competitor_min"),
                    F.coalesce(F.col("max"), F.col("seed_price")).alias("competitor_max"),
                    F.col("min").isNotNull().alias("is_live"))
