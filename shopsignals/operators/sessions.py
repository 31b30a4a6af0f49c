"""Session, affinity and competitor-state operators in batch form.

These are the batch twins of the streaming operators (K2/K5/K6) and the
session-sequence preparation of the next-item model (E5–E7, E11, E12, D27).
All windows are partitioned by a session / user / product key; a hot key
only concentrates that key's rows, never the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.functions.columns import INTENT_BASE, LIVE_EVENT_TYPES, event_weight, lookup, round_to
from shopsignals.operators.pricing import session_wtp_expr

INTERACTION_EVENTS = ["page_view", "product_view", "add_to_cart", "purchase", "search"]


# ------------------------------------------------------------------------- E5
def session_progress(events: DataFrame, session="session_id", order=("timestamp", "event_id")) -> DataFrame:
    """E5: running event count within the session (arrival order); a large
    session is split across tasks (``running_position``), events without a
    session count as one."""
    return running_position(events, session, order, None)


def engagement_expr(length, event_type):
    depth = F.least(F.col(length) / 20.0, F.lit(1.0))
    return round_to(0.6 * depth + 0.4 * event_weight(event_type, "live"), 4)


def intent_expr(event_type, engagement):
    base = lookup(event_type, INTENT_BASE, 0.05).cast("double")
    return round_to(F.least(base + F.col(engagement) * 0.2, F.lit(1.0)), 4)


def _gap_clock(col: str):
    """Wall-clock microseconds, independent of the session time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  f"CAST(`{col}` AS TIMESTAMP_NTZ))")


def running_position(events: DataFrame, key: str = "session_id", order=("timestamp", "event_id"),
                     ttl_seconds: int | None = None, out: str = "session_length",
                     time_col: str | None = None) -> DataFrame:
    """Per-event running position within ``key`` in ``order``, restarting
    after a gap longer than ``ttl_seconds`` (None: never).

    One plan at every size, in which no task sorts a whole key:

    1. Range-partition on (key, order): a large key is split over consecutive
       partitions; written once so partition ids are stable.
    2. Inside each (partition, key) piece: local position, gap flags and the
       last local segment start (a window over a bounded piece).
    3. Only the first and last key of each partition can continue across a
       boundary: their piece sizes, first/last times and local resets form a
       table of at most 2 rows per partition (a proven bound → broadcast),
       from which offsets and entering segment starts are carried.

    Rows without a key are one group, like any other key.
    """
    return _positions(events, key, order, ttl_seconds, time_col).withColumn(
        out, (F.col("_pos") - F.col("_start") + 1).cast("bigint")).drop("_pos", "_start")


def _positions(events, key, order, ttl_seconds, time_col) -> DataFrame:
    """``events`` with _pos (position within the key) and _start (position at
    which the current segment of the key began)."""
    from shopsignals.session import materialize

    ttl_us = None if ttl_seconds is None else int(ttl_seconds) * 1_000_000
    ts = _gap_clock(time_col or order[0])
    # a struct is never NULL itself: its equality and order treat a NULL key as a value
    ranged = materialize(events.withColumn("_ts", ts).withColumn("_key", F.struct(F.col(key).alias("k")))
                         .repartitionByRange("_key", *order).withColumn("_pid", F.spark_partition_id()))
    wl = Window.partitionBy("_pid", "_key").orderBy(*order)
    r = ranged.withColumn("_lpos", F.row_number().over(wl))
    if ttl_us is None:
        r = r.withColumn("_lstart", F.lit(None).cast("int"))
    else:
        gap = F.coalesce((F.col("_ts") - F.lag("_ts").over(wl)) > F.lit(ttl_us), F.lit(False))
        r = r.withColumn("_lstart", F.max(F.when(gap, F.col("_lpos"))).over(
            wl.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ranged.groupBy("_pid").agg(F.min("_key").alias("_f"), F.max("_key").alias("_l"))
    bkeys = ends.select("_pid", F.col("_f").alias("_key")).union(ends.select("_pid", F.col("_l").alias("_key"))).distinct()
    bstats = (r.join(F.broadcast(bkeys), ["_pid", "_key"], "left_semi").groupBy("_pid", "_key")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("_ts").alias("_fts"), F.max("_ts").alias("_lts"),
                   F.max("_lstart").alias("_lr")))
    wb = Window.partitionBy("_key").orderBy("_pid")
    prev_rows = wb.rowsBetween(Window.unboundedPreceding, -1)
    b = (bstats.withColumn("_off", F.coalesce(F.sum("_n").over(prev_rows), F.lit(0)))
               .withColumn("_plts", F.lag("_lts").over(wb)))
    fnew = F.col("_plts").isNull()
    if ttl_us is not None:
        fnew = fnew | ((F.col("_fts") - F.col("_plts")) > F.lit(ttl_us))
    b = b.withColumn("_fnew", fnew).withColumn(
        "_rp", F.greatest(F.when(F.col("_lr").isNotNull(), F.col("_off") + F.col("_lr")),
                          F.when(F.col("_fnew"), F.col("_off") + 1)))
    b = b.withColumn("_enter", F.when(F.col("_fnew"), F.col("_off") + 1).otherwise(F.max("_rp").over(prev_rows)))
    x = r.join(F.broadcast(b.select("_pid", "_key", "_off", "_enter")), ["_pid", "_key"], "left")
    off = F.coalesce(F.col("_off"), F.lit(0))
    start = F.when(F.col("_lstart").isNotNull(), off + F.col("_lstart")).otherwise(
        F.coalesce(F.col("_enter"), F.lit(1)))
    return (x.withColumn("_pos", off + F.col("_lpos")).withColumn("_start", start)
             .drop("_ts", "_pid", "_key", "_lpos", "_lstart", "_off", "_enter"))


def last_segment(df: DataFrame, key: str, order, ttl_seconds: int, time_col: str | None = None) -> DataFrame:
    """Rows of each key after its last gap longer than ``ttl_seconds`` — what
    a store whose entry expires that long after its last write still holds:
    the segment with the largest start (a per-key max aggregate)."""
    g = _positions(df, key, order, ttl_seconds, time_col)
    last = g.groupBy(F.col(key).alias("_last_key")).agg(F.max("_start").alias("_last"))
    return (g.join(last, F.col(key).eqNullSafe(F.col("_last_key")) & (F.col("_start") == F.col("_last")))
             .drop("_pos", "_start", "_last", "_last_key"))


def session_progress_ttl(events: DataFrame, ttl_seconds: int = 1800, session="session_id",
                         order=("timestamp", "event_id")) -> DataFrame:
    """Running session length that restarts when the gap to the previous
    event of the session exceeds ``ttl_seconds`` — the feature hash expires
    that long after its last write, so the next event starts from zero.

    Computed by ``running_position`` (range split + boundary carry), so a
    session holding a large share of all events is not sorted by one task.
    """
    return running_position(events, session, order, ttl_seconds)


# ------------------------------------------------------------------------- K3
def session_features_batch(events: DataFrame, catalog: DataFrame, final_only: bool = False,
                           ttl_seconds: int | None = 1800) -> DataFrame:
    """K3: per-event session features (K2's batch twin); ``final_only`` keeps
    the last event of each session, i.e. the feature-store row.

    events: live clicks (event_id, timestamp, user_id, session_id, product_id,
    event_type); catalog: (sku_id, base_price_usd). The length restarts after
    a gap longer than the 30-minute feature TTL (``ttl_seconds=None``: never).
    """
    ev = events.where(F.col("session_id").isNotNull() & (F.col("session_id").cast("string") != ""))
    ev = session_progress(ev) if ttl_seconds is None else session_progress_ttl(ev, ttl_seconds)
    cat = catalog.select(F.col("sku_id").alias("_sku"), F.col("base_price_usd").alias("_base"))
    ev = ev.join(cat, ev["product_id"] == cat["_sku"], "left")
    ev = (ev.withColumn("engagement_score", engagement_expr("session_length", "event_type"))
            .withColumn("intent_probability", intent_expr("event_type", "engagement_score"))
            .withColumn("wtp_estimate", session_wtp_expr(F.col("_base"), F.col("intent_probability")))
            .withColumn("last_event_type", F.col("event_type"))
            .withColumn("last_product_id", F.col("product_id"))
            .drop("_sku", "_base"))
    if final_only:
        # newest event per session as an aggregate (combined map-side)
        others = [c for c in ev.columns if c != "session_id"]
        ev = (ev.groupBy("session_id")
                .agg(F.max_by(F.struct(*others), F.struct("timestamp", "event_id")).alias("_last"))
                .select("session_id", *[F.col(f"_last.{c}").alias(c) for c in others]))
    return ev


# ------------------------------------------------------------------------ D25
def competitor_snapshot(feed: DataFrame, product="product_id", competitor="competitor",
                        price="price", order=None, ttl_seconds: int | None = None) -> DataFrame:
    """Latest price per (product, competitor), then min/max per product.

    Bad prices (not parseable) and empty product ids are dropped first, like
    the stream handler. Both steps are aggregates (``max_by``), partial on
    the map side; no window over a product's whole history. With
    ``ttl_seconds`` only events after the product's last gap longer than the
    TTL count (the product hash expired and started over) — the K6 twin.
    ``order`` is arrival order: ``seq`` where the feed has it, else the time.
    """
    order = order or (("seq",) if "seq" in feed.columns else ("timestamp",))
    numeric = dict(feed.dtypes).get(price, "string") != "string"
    # string prices (the stream) are parsed and bad ones dropped; numeric ones pass as is
    p = F.col(price).cast("double") if numeric else F.col(price).try_cast("double")
    f = (feed.withColumn("_p", p)
             .where(F.col("_p").isNotNull() & F.col(product).isNotNull()
                    & (F.col(product).cast("string") != ""))
             .withColumn(competitor, F.coalesce(F.col(competitor), F.lit("unknown"))))
    if ttl_seconds is not None:
        ordcols = tuple([o for o in order if o in feed.columns] + ["_p"])
        f = last_segment(f, product, ordcols, ttl_seconds, time_col="timestamp")
    # arrival order; the price itself breaks exact ties so the result is total
    ordk = F.struct(*[F.col(o) for o in order if o in feed.columns], F.col("_p"))
    latest = (f.groupBy(product, competitor)
              .agg(F.max_by("_p", ordk).alias("price")))
    return latest.groupBy(product).agg(F.min("price").alias("min"), F.max("price").alias("max"),
                                       F.count(F.lit(1)).cast("bigint").alias("n_competitors"))


# ------------------------------------------------------------------ K7 in batch
def window_kpis(events: DataFrame, pane: str = "5 minutes", window: str = "30 minutes") -> DataFrame:
    """K7's batch twin: events, events per live type and distinct sessions of every
    sliding window, exactly. Sessions are made distinct per pane before panes are
    spread over their windows."""
    at = F.col("timestamp").cast("timestamp")
    counts = [F.count_if(F.col("event_type") == t).alias(t) for t in LIVE_EVENT_TYPES]
    panes = (events.where(F.col("timestamp").isNotNull()).groupBy(F.window(at, pane).alias("_pane"), F.col("session_id").cast("string").alias("_s"))
             .agg(F.count(F.lit(1)).alias("events"), *counts))
    held = panes.withColumn("_window", F.window(F.col("_pane.start"), window, pane))
    per = held.groupBy("_window", "_s").agg(F.sum("events").alias("events"), *[F.sum(t).alias(t) for t in LIVE_EVENT_TYPES])
    out = per.groupBy("_window").agg(F.sum("events").alias("events"), *[F.sum(t).alias(t) for t in LIVE_EVENT_TYPES],
                                     F.count("_s").alias("active_sessions"))
    return out.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "events", *LIVE_EVENT_TYPES, "active_sessions")


# ------------------------------------------------------------------------ D26
def user_affinity(events: DataFrame, catalog: DataFrame, ttl_seconds: int | None = None) -> DataFrame:
    """Σ live weight per (user, category) and each user's top category.

    Returns (user_id, category, score, top_category); ties for the top go to
    the category name in ascending order. With ``ttl_seconds`` (the K5 twin:
    the affinity hash expires 24 h after its last increment) only the user's
    events after the last longer gap count.
    """
    ev = events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    cat = catalog.select(F.col("sku_id").alias("_sku"), F.col("category").alias("category"))
    j = ev.join(cat, ev["product_id"] == cat["_sku"], "inner").where(F.col("category").isNotNull())
    if ttl_seconds is not None:
        j = last_segment(j, "user_id", ("timestamp", "event_id"), ttl_seconds)
    aff = (j.groupBy("user_id", "category")
           .agg(F.sum(event_weight("event_type", "live")).alias("score")))
    top = (aff.groupBy("user_id")
           # equal sums may differ in the last bits with the summation order:
           # compare the score rounded to 12 digits, then the category name
           .agg(F.min_by("category", F.struct((-F.round(F.col("score"), 12)).alias("s"), F.col("category")))
                .alias("top_category")))
    return aff.join(top, "user_id", "inner")


# ------------------------------------------------------------------------ D27
def _first_seen(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, product_id, _first, category): first view of each catalog product per user (C11)."""
    ev = events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    first = (ev.groupBy("user_id", "product_id")
             .agg(F.min(F.struct("timestamp", "event_id")).alias("_first")))
    cat = catalog.select(F.col("sku_id").alias("product_id"), "category")
    return first.join(cat, "product_id", "inner")


def session_view(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per user — number of distinct viewed catalog products, the first
    one, top category (ties → first seen), last active and the journey text.

    Everything is an aggregate, so a user with a huge history is combined
    map-side; the ordered product list is ``session_view_products`` (long
    form), never one array per user.
    """
    ev = events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    last = ev.groupBy("user_id").agg(F.max("timestamp").alias("last_active"))
    seen = _first_seen(events, catalog)
    cat_counts = (seen.groupBy("user_id", "category")
                  .agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_f")))
    top = cat_counts.groupBy("user_id").agg(
        F.min_by("category", F.struct((-F.col("_n")).alias("n"), F.col("_f").alias("f"))).alias("top_category"))
    prods = seen.groupBy("user_id").agg(F.min_by("product_id", F.col("_first")).alias("first_product"),
                                        F.count(F.lit(1)).cast("bigint").alias("total_views"))
    out = last.join(prods, "user_id", "left").join(top, "user_id", "left")
    tv = F.coalesce(F.col("total_views"), F.lit(0))
    journey = F.when(tv == 0, F.lit("Start browsing to build your personalized journey!")).otherwise(
        F.concat(F.lit("You've explored "), tv.cast("string"), F.lit(" product(s), showing strong interest in "),
                 F.col("top_category"), F.lit(". We're tailoring recommendations based on your journey.")))
    return out.select("user_id", tv.alias("total_views"), "first_product", "top_category",
                      journey.alias("journey_explanation"), "last_active")


def session_view_products(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """D27 product list in long form: (user_id, position, product_id) in
    first-seen order; positions from ``running_position`` (hot users split)."""
    seen = _first_seen(events, catalog).select("user_id", "product_id", F.col("_first.timestamp").alias("_ts"),
                                               F.col("_first.event_id").alias("_eid"))
    pos = running_position(seen, "user_id", ("_ts", "_eid"), None, "position")
    return pos.select("user_id", "position", "product_id")


# ------------------------------------------------------------------------ E11
def build_vocab(catalog: DataFrame) -> DataFrame:
    """Sorted SKU → index from 1 (0 is padding).

    ``zipWithIndex``-style ranks without a single-partition window: a range
    sort, then per-partition offsets from partition sizes.
    """
    skus = catalog.select("sku_id").where(F.col("sku_id").isNotNull()).distinct()
    return _dense_index(skus, "sku_id", "item_idx", start=1)


def dense_index(df: DataFrame, key: str, out: str, start: int = 0) -> DataFrame:
    """Position of each (distinct) ``key`` in sorted order, starting at ``start``."""
    return _dense_index(df, key, out, start)


def _dense_index(df: DataFrame, key: str, out: str, start: int = 0) -> DataFrame:
    """Global 0/1-based position in ``key`` order, computed distributed:
    range-partition + sort, count rows per partition (a tiny aggregate),
    prefix-sum the counts, add the in-partition row number."""
    from shopsignals.session import materialize

    # the range split samples its bounds: materialise it once (a written
    # table) so the counts and the rows see the same partition ids
    s = materialize(df.repartitionByRange(key).sortWithinPartitions(key)
                    .withColumn("_pid", F.spark_partition_id()))
    s = s.withColumn("_i", F.row_number().over(Window.partitionBy("_pid").orderBy(key)))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    # offs has one row per partition: its broadcast is bounded by the partition count
    return (s.join(F.broadcast(offs), "_pid")
             .withColumn(out, (F.col("_off") + F.col("_i") - 1 + start).cast("bigint"))
             .drop("_pid", "_i", "_off"))


# ------------------------------------------------------------------------- E6
def session_sequences(events: DataFrame, catalog: DataFrame, max_len: int = 50,
                      min_len: int = 3, types=INTERACTION_EVENTS, salts: int = 16) -> DataFrame:
    """Interaction events of catalog SKUs per session, last ``max_len``,
    sessions with at least ``min_len`` events; one row per (session, pos).

    Long form keeps a session's events spread across tasks until the final
    window; ``sequence_arrays`` gives the array form.
    """
    ev = events.where(F.col("timestamp").isNotNull() & F.col("session_id").isNotNull()
                      & F.col("sku_id").isNotNull() & F.col("event_type").isin(list(types)))
    vocab = build_vocab(catalog)
    ev = ev.join(vocab, "sku_id", "inner")
    # session sizes: a partial aggregate, never a window over a whole session
    sizes = ev.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_len)
    # exact last-max_len per session in two stages: the newest max_len of each
    # (session, salt) slice first, so a hot session is cut down in parallel
    # and the final window sees at most salts × max_len rows per session
    desc = [F.col("timestamp").desc(), F.col("event_id").desc()]
    ev = ev.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)))
    ev = ev.withColumn("_r1", F.row_number().over(Window.partitionBy("session_id", "_salt").orderBy(*desc)))
    ev = ev.where(F.col("_r1") <= max_len).join(sizes, "session_id", "inner")
    ev = ev.withColumn("_rdesc", F.row_number().over(Window.partitionBy("session_id").orderBy(*desc)))
    ev = ev.where(F.col("_rdesc") <= max_len)
    kept = F.least(F.col("_n"), F.lit(max_len))
    return ev.select("session_id", "event_id", "timestamp", "sku_id", "item_idx",
                     (kept - F.col("_rdesc") + 1).cast("int").alias("pos"),
                     kept.cast("int").alias("seq_len"))


def sequence_arrays(seqs: DataFrame) -> DataFrame:
    """E6 array form: (session_id, items array<bigint> in order)."""
    return seqs.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_idx"))),
                    lambda s: s["item_idx"]).alias("items"))


# ------------------------------------------------------------------------- E7
def next_item_samples(seq_arrays: DataFrame, max_len: int = 50, min_len: int = 3) -> DataFrame:
    """Each prefix → next item; left-padded to ``max_len`` with a mask.

    For a sequence of n items the targets are positions min_len..n (1-based);
    the input is the prefix before it.
    """
    x = seq_arrays.select("session_id", "items",
                          F.explode(F.sequence(F.lit(min_len), F.size("items"))).alias("end_idx"))
    prefix = F.slice("items", 1, F.col("end_idx") - 1)
    pad = F.lit(max_len) - F.size(prefix)
    return x.select(
        "session_id", "end_idx",
        F.element_at("items", F.col("end_idx")).alias("target"),
        F.concat(F.array_repeat(F.lit(0).cast("bigint"), pad), prefix).alias("padded"),
        F.concat(F.array_repeat(F.lit(True), pad), F.array_repeat(F.lit(False), F.size(prefix))).alias("mask"),
        F.size(prefix).alias("prefix_len"))


# ------------------------------------------------------------------------ E12
def session_context(events: DataFrame, types=INTERACTION_EVENTS, catalog: DataFrame | None = None) -> DataFrame:
    """Context of each session's first interaction event (of a catalog
    SKU when ``catalog`` is given): device and referral codes over all
    interaction events (alphabetical, rule Q13), one-hot arrays and hour/24."""
    ev = events.where(F.col("session_id").isNotNull() & F.col("event_type").isin(list(types)))
    ctx_ev = ev
    if catalog is not None:
        ctx_ev = ev.join(catalog.select("sku_id").distinct(), "sku_id", "left_semi")
    first = (ctx_ev.groupBy("session_id")
             .agg(F.min_by(F.struct("device_type", "referral_source", "hour_of_day"),
                           F.struct("timestamp", "event_id")).alias("_f"))
             .select("session_id", "_f.*"))
    out = first

    for col, code in (("device_type", "device_idx"), ("referral_source", "referral_idx")):
        labels = ev.select(F.col(col).alias("_lab")).where(F.col("_lab").isNotNull()).distinct()
        codes = _dense_index(labels, "_lab", code)
        n = codes.select(F.count(F.lit(1))).scalar()
        codes = codes.withColumn(code, F.col(code).cast("int")).withColumn(f"_n_{code}", n)
        out = out.join(codes, out[col] == codes["_lab"], "left").drop("_lab")
    onehot = lambda idx, n: F.transform(F.sequence(F.lit(0), F.col(n) - 1),
                                        lambda i: F.when(i == F.col(idx), 1.0).otherwise(0.0))
    return out.select("session_id", "device_idx", "referral_idx",
                      (F.coalesce(F.col("hour_of_day"), F.lit(12)).cast("double") / 24.0).alias("hour_norm"),
                      F.concat(onehot("device_idx", "_n_device_idx"), onehot("referral_idx", "_n_referral_idx"),
                               F.array((F.coalesce(F.col("hour_of_day"), F.lit(12)).cast("double") / 24.0)))
                      .alias("context"))
