"""Streaming operators (K1–K8).

Each has a batch twin in ``shopsignals.operators`` and the tests run both on
the same events. The reference's feature hashes expire a fixed time after
their last write; here an event after a longer gap starts the key's value
over, and the state itself is dropped by an event-time timer, so replays give
identical results. Keyed state (``keyed_state``) lives in Spark's state store
(checkpointed with the query), so a lost executor replays from the checkpoint;
sinks write by batch id, so a replayed batch overwrites instead of duplicating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.functions.columns import LIVE_EVENT_TYPES, event_weight
from shopsignals.operators.pricing import decide_prices, discount_pct, price_requests, session_wtp_expr
from shopsignals.operators.sessions import engagement_expr, intent_expr
from shopsignals.streaming.keyed_state import Affinity, CompetitorRange, Lookup, PriceCache, RunningLength, with_state

SESSION_TTL_MS = 30 * 60 * 1000
AFFINITY_TTL_MS = 24 * 60 * 60 * 1000
COMPETITOR_TTL_MS = 6 * 60 * 60 * 1000


# ------------------------------------------------------------------ B15 / K1
def validity(df: DataFrame, required=("user_id", "session_id", "product_id", "event_type"),
             types=LIVE_EVENT_TYPES) -> F.Column:
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return ok & F.col("event_type").isin(list(types))


def validate_events(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) — one boolean, two filters; works on batch or stream."""
    v = validity(df, **kw)
    return df.where(v), df.where(~v)


def valid_clicks(stream: DataFrame, watermark: str = "30 minutes", dedupe: bool = True) -> tuple[DataFrame, DataFrame]:
    """K1: valid click events (replays of an event_id dropped within the
    watermark) and the rejects for a side sink."""
    ok, bad = validate_events(stream)
    if dedupe:
        ok = ok.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return ok, bad


# ------------------------------------------------------------------------ K2
_SESSION_OUT = ("session_id string, event_id long, timestamp timestamp, user_id long, product_id long, event_type string, "
                "session_length long")


def session_features(stream: DataFrame, catalog: DataFrame) -> DataFrame:
    """K2: per-event live session features (the K3 twin). The only Python is
    the running counter; engagement, intent and WTP are native columns after
    it and the catalog join is stream-static."""
    ev = stream.where(F.col("session_id").isNotNull() & (F.col("session_id") != "")) \
               .select("session_id", "event_id", "timestamp", "user_id", "product_id", "event_type",
                       F.unix_millis(F.col("timestamp").cast("timestamp")).alias("at_ms")) \
               .withWatermark("timestamp", "30 minutes")
    counted = with_state(ev, ["session_id"], RunningLength(SESSION_TTL_MS), _SESSION_OUT)
    cat = catalog.select(F.col("sku_id").alias("_sku"), F.col("base_price_usd").alias("_base"))
    j = counted.join(cat, counted["product_id"] == cat["_sku"], "left")
    return (j.withColumn("engagement_score", engagement_expr("session_length", "event_type"))
             .withColumn("intent_probability", intent_expr("event_type", "engagement_score"))
             .withColumn("wtp_estimate", session_wtp_expr(F.col("_base"), F.col("intent_probability")))
             .withColumn("last_event_type", F.col("event_type"))
             .withColumn("last_product_id", F.col("product_id"))
             .withColumn("updated_at", F.current_timestamp())
             .drop("_sku", "_base"))


# ------------------------------------------------------------------------ K4
def session_features_windowed(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """K4: closed sessions (event-time gap) with length and last event; rows
    are emitted once the watermark passes the session end (append mode)."""
    ts = F.col("timestamp").cast("timestamp")
    ev = stream.withColumn("_ts", ts).withWatermark("_ts", gap)
    return (ev.groupBy(F.session_window("_ts", gap).alias("w"), "session_id")
              .agg(F.count(F.lit(1)).alias("session_length"),
                   F.max_by("event_type", F.struct("_ts", "event_id")).alias("last_event_type"),
                   F.max_by("product_id", F.struct("_ts", "event_id")).alias("last_product_id"))
              .select("session_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                      "session_length", "last_event_type", "last_product_id"))


# ------------------------------------------------------------------------ K5
def affinity_stream(stream: DataFrame, catalog: DataFrame) -> DataFrame:
    """K5: running Σ live weight per (user, category) — stream-static join,
    streaming aggregate (update mode)."""
    cat = catalog.select(F.col("sku_id").alias("_sku"), "category")
    ev = stream.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    j = ev.join(cat, ev["product_id"] == cat["_sku"], "inner")
    return j.groupBy("user_id", "category").agg(F.sum(event_weight("event_type", "live")).alias("score"))


def affinity_stream_ttl(stream: DataFrame, catalog: DataFrame) -> DataFrame:
    """K5 with the 24 h idle expiry (the ``user_affinity(ttl_seconds=86400)``
    twin): keyed state per user, update mode, every touched user re-emitted
    with all of its current category scores."""
    cat = catalog.select(F.col("sku_id").alias("_sku"), "category")
    ev = stream.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    j = (ev.join(cat, ev["product_id"] == cat["_sku"], "inner").where(F.col("category").isNotNull())
           .select("user_id", "category", "timestamp", "event_id",
                   F.unix_millis(F.col("timestamp").cast("timestamp")).alias("at_ms"),
                   event_weight("event_type", "live").alias("weight"))
           .withWatermark("timestamp", "24 hours"))
    return with_state(j, ["user_id"], Affinity(AFFINITY_TTL_MS), "user_id long, category string, score double", "update")


# ------------------------------------------------------------------------ K6
def competitor_stream_state(stream: DataFrame) -> DataFrame:
    """K6: running competitor min/max per product (the D25 twin). Rows with
    an unparseable price or an empty product id are dropped first."""
    s = stream.withColumn("value", F.col("price").cast("string").try_cast("double")) \
              .where(F.col("value").isNotNull() & F.col("product_id").isNotNull()) \
              .withColumn("competitor", F.coalesce("competitor", F.lit("unknown"))) \
              .select("product_id", "competitor", "value", "timestamp", "seq",
                      F.unix_millis(F.col("timestamp").cast("timestamp")).alias("at_ms")) \
              .withWatermark("timestamp", "6 hours")
    return with_state(s, ["product_id"], CompetitorRange(COMPETITOR_TTL_MS),
                      "product_id long, min double, max double, n_competitors long", "update")


# ------------------------------------------------------------------------ K7
def live_kpis(stream: DataFrame) -> DataFrame:
    """K7: running event count per type and approximate active sessions."""
    return stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"),
                                            F.approx_count_distinct("session_id").alias("sessions"))


def live_window_kpis(events: DataFrame, pane: str = "5 minutes", window: str = "30 minutes", delay: str = "10 minutes",
                     log2_size: int = 12) -> DataFrame:
    """K7 over a sliding event-time window (append mode; a batch works as well):
    window_start, window_end, events, one count per live event type, and
    active_sessions, the distinct sessions of the window.

    An event is counted once, in its pane; a window merges the panes it covers.
    Sessions are a mergeable sketch of 2 ** ``log2_size`` registers per pane, so
    state does not grow with sessions; its standard error is about
    1 / sqrt(2 ** ``log2_size``). ``operators.sessions.window_kpis`` counts exactly.
    """
    timed = events.withColumn("_at", F.col("timestamp").cast("timestamp")).where("_at is not null")
    timed = timed.withWatermark("_at", delay) if events.isStreaming else timed
    types = [F.count_if(F.col("event_type") == t).alias(t) for t in LIVE_EVENT_TYPES]
    panes = timed.groupBy(F.window("_at", pane).alias("_pane")).agg(
        F.count(F.lit(1)).alias("events"), *types, F.hll_sketch_agg(F.col("session_id").cast("string"), log2_size).alias("_sessions"))
    merged = panes.groupBy(F.window(F.window_time("_pane"), window, pane).alias("_window")).agg(
        F.sum("events").alias("events"), *[F.sum(t).alias(t) for t in LIVE_EVENT_TYPES], F.hll_union_agg("_sessions").alias("_sessions"))
    return merged.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), "events", *LIVE_EVENT_TYPES,
                         F.hll_sketch_estimate("_sessions").alias("active_sessions"))


# ------------------------------------------------------------------------ K8
_REQUEST = "event_id long, timestamp timestamp, product_id long, user_id long, session_id string, variant string"
_FEATURES = ["intent_probability", "engagement_score", "wtp_estimate"]


def _tagged(requests: DataFrame, updates: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Requests and updates as rows of one stream; what an update lacks of a
    request is filled in (a null would turn the frames' integers into floats)."""
    empty = {"long": F.lit(0), "string": F.lit("")}
    columns = [c.split() for c in _REQUEST.split(", ")]
    fill = [F.coalesce(F.col(n), empty[t]).cast(t).alias(n) if n in (key, "event_id") and n in updates.columns
            else F.col(n) if t == "timestamp" else empty[t].cast(t).alias(n) for n, t in columns]
    both = updates.select(*fill, F.lit(False).alias("is_request"), *[F.col(n).cast("double").alias(n) for n in names])
    rest = [c for c in requests.columns if c not in [n for n, _ in columns] + names]
    both = both.withColumns({c: F.lit(None).cast(requests.schema[c].dataType) for c in rest})
    asked = requests.withColumn("is_request", F.lit(True)).withColumns({n: F.lit(None).cast("double") for n in names})
    return both.unionByName(asked).withColumn("at_ms", F.unix_millis("timestamp"))


def price_stream(requests: DataFrame, features: DataFrame, competitor: DataFrame, products: DataFrame, delay: str = "10 minutes",
                 feature_ttl_ms: int = SESSION_TTL_MS, competitor_ttl_ms: int = COMPETITOR_TTL_MS, cache_ttl_ms: int = 60_000) -> DataFrame:
    """K8: price requests as they come (append mode), the stream form of
    ``price_requests`` and ``serve_cached``.

    requests: event_id, timestamp, product_id, user_id, session_id, optionally
    variant; features: session updates as ``session_features`` gives them;
    competitor: (timestamp, product_id, min) as ``competitor_stream_state`` does;
    products: a table (product_id, base_price).

    Three keyed states, each fed by one tagged stream: a request meets the latest
    features of its session, then the latest competitor price of its product, and
    is priced; then the price given to its user for its product less than
    ``cache_ttl_ms`` before, if there is one, replaces its own. Nothing is read
    again from a snapshot. A value is out of date its time to live after the
    update. Requests later than the watermark (``delay``) are dropped, as are those
    without an id or of an unknown product.
    """
    asked = requests.withColumn("variant", F.coalesce("variant", F.lit("A")) if "variant" in requests.columns else F.lit("A"))
    for c in ("event_id", "timestamp", "product_id", "user_id", "session_id"):
        asked = asked.where(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    columns = [c.split() for c in _REQUEST.split(", ")]
    asked = asked.select(*[F.col(n).cast(t).alias(n) for n, t in columns])
    wanted = [n for n, _ in columns]
    known = features.where(F.col("session_id").isNotNull() & F.col("timestamp").isNotNull())
    met = _tagged(asked, known, "session_id", _FEATURES).withWatermark("timestamp", delay)
    met = with_state(met, ["session_id"], Lookup(feature_ttl_ms, _FEATURES, [*wanted, *_FEATURES]),
                     f"{_REQUEST}, {', '.join(f'{n} double' for n in _FEATURES)}", event_time="timestamp")
    offers = competitor.where(F.col("product_id").isNotNull() & F.col("timestamp").isNotNull()).withColumn("competitor_min", F.col("min"))
    met = _tagged(met, offers.withWatermark("timestamp", delay), "product_id", ["competitor_min"])
    met = with_state(met, ["product_id"], Lookup(competitor_ttl_ms, ["competitor_min"], [*wanted, *_FEATURES, "competitor_min"]),
                     f"{_REQUEST}, {', '.join(f'{n} double' for n in _FEATURES)}, competitor_min double", event_time="timestamp")
    known_products = products.select(F.col("product_id").alias("known_id"), F.col("base_price").cast("double").alias("base_price"))
    priced = decide_prices(met.join(known_products, met["product_id"] == known_products["known_id"], "inner").drop("known_id"))
    numbers = ["base_price", *_FEATURES, "competitor_min", "raw_price", "final_price"]
    out = f"{_REQUEST}, {', '.join(f'{n} double' for n in numbers)}, rule_reason string, reason string"
    names = [c.split()[0] for c in out.split(", ")]
    priced = priced.select(*names, F.unix_micros("timestamp").alias("at_us"))
    served = with_state(priced, ["product_id", "user_id"], PriceCache(cache_ttl_ms, [*names, "cache_hit"]), f"{out}, cache_hit boolean")
    return served.withColumn("discount_pct", discount_pct("final_price", "base_price"))


def price_stream_batch(products: DataFrame, features_path: str, competitor_path: str, log_path: str):
    """K8 from tables: ``foreachBatch`` function pricing each micro-batch of
    requests from the keyed tables (A12) of features and competitor prices, of
    which it reads what can hold the batch's keys, into the price log.

    Writes go to ``log_path/batch_id=<n>`` with overwrite, so a replayed batch
    replaces its own output (idempotent under retries).
    """
    from shopsignals.sources.sinks import read_latest

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        feats = read_latest(spark, features_path, batch.select("session_id").where("session_id is not null"))
        comp = read_latest(spark, competitor_path, batch.select("product_id").where("product_id is not null"))
        if feats is None:  # no session written yet: defaults apply
            feats = spark.createDataFrame([], "session_id string, intent_probability double, "
                                              "engagement_score double, wtp_estimate double")
        if comp is None:
            comp = spark.createDataFrame([], "product_id long, min double").withColumn(
                "product_id", F.col("product_id").cast(products.schema["product_id"].dataType))
        priced = price_requests(batch, products, feats, comp).withColumn("batch_id", F.lit(batch_id))
        priced.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    return run
