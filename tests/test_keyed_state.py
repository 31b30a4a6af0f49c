"""Keyed stream state: order within a key, hot keys, the price stream with its cache."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopsignals.operators import sessions as ss
from shopsignals.plans import q_pricing, registry
from shopsignals.sources.fixtures import view
from shopsignals.streaming import keyed_state as ks
from shopsignals.streaming import operators as so
from shopsignals.streaming import sources as src
from tests.conftest import SF_SMALL


class Spill(dict):
    """A map state in memory that knows how much it held."""

    most = 0

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(self))

    getValue = dict.__getitem__
    removeKey = dict.pop


@pytest.mark.parametrize("n,size", [(0, 10), (7, 10), (11, 10), (5000, 100)])
def test_frames_come_in_order_and_stay_small(n, size):
    rnd = random.Random(n)
    rows = [(rnd.choice([5, rnd.randint(0, 10**6)]) if i % 97 == 0 else rnd.randint(0, 10**6), i) for i in range(n)]
    rnd.shuffle(rows)
    spill = Spill()
    frames = list(ks.in_order((pd.DataFrame(rows[i:i + size], columns=["at_ms", "event_id"]) for i in range(0, n, size)), ["at_ms", "event_id"], spill))
    got = [tuple(r) for f in frames for r in f.itertuples(index=False)]
    assert got == sorted(rows) and not spill
    assert max((len(f) for f in frames), default=0) <= 3 * size


def _run(out, name, ck, mode="append"):
    q = (out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return out.sparkSession.table(name)


@pytest.fixture()
def small_frames(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "250")
    yield
    spark.conf.set(key, before)


def test_hot_keys_in_one_micro_batch(spark, tmp_dir, small_frames):
    """One session, user and product hold nearly all events of a batch."""
    cat = view(spark, SF_SMALL, "fx_catalog")
    skus = [r[0] for r in cat.select("sku_id").orderBy("sku_id").limit(5).toLocalIterator()]
    pick = F.element_at(F.array(*[F.lit(s) for s in skus]), (F.col("id") % 5 + 1).cast("int"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3 + F.floor(F.col("id") / 900) * 4000 + F.floor(F.col("id") / 1500) * 90_000)
    ev = spark.range(1700).select(
        F.col("id").alias("event_id"), at.alias("timestamp"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(7).alias("user_id"),
        F.when(F.col("id") % 40 == 0, F.col("id").cast("string")).otherwise("hot").alias("session_id"), pick.cast("long").alias("product_id"),
        F.element_at(F.array(F.lit("cart"), F.lit("page_view"), F.lit("search")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"))
    d = os.path.join(tmp_dir, "clicks")
    ev.orderBy(F.xxhash64("event_id")).repartition(3).write.parquet(d)
    got = _run(so.session_features(src.click_stream(spark, d), cat), "hot_k2", os.path.join(tmp_dir, "c2"))
    cols = ["event_id", "session_length", "engagement_score", "intent_probability", "wtp_estimate"]
    want = ss.session_features_batch(ev, cat)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    aff = _run(so.affinity_stream_ttl(src.click_stream(spark, d), cat), "hot_k5", os.path.join(tmp_dir, "c5"), "update")
    twin = ss.user_affinity(ev, cat, ttl_seconds=86400)
    key = lambda df: sorted((r["user_id"], r["category"], round(r["score"], 6)) for r in df.collect())
    assert key(aff) == key(twin)
    feed = ev.select(F.col("event_id").alias("seq"), "timestamp", F.lit(1).cast("long").alias("product_id"),
                     F.concat(F.lit("S"), F.col("event_id") % 4).alias("competitor"), (100 + F.col("event_id") % 17).cast("string").alias("price"))
    f = os.path.join(tmp_dir, "feed")
    feed.orderBy(F.xxhash64("seq")).repartition(3).write.parquet(f)
    comp = _run(so.competitor_stream_state(src.competitor_stream(spark, f)), "hot_k6", os.path.join(tmp_dir, "c6"), "update")
    snap = ss.competitor_snapshot(spark.read.parquet(f), order=("seq",), ttl_seconds=6 * 3600)
    assert [tuple(r) for r in comp.collect()] == [tuple(r) for r in snap.select("product_id", "min", "max", "n_competitors").collect()]


def _stream(spark, path, schema, per_batch=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_batch)).parquet(path)


def _in_files(df, path, by, n):
    """``df`` as n files in the order of the column ``by``, one append each."""
    cuts = [df.selectExpr(f"percentile({by}, {k / n})").first()[0] for k in range(1, n)]
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = df
        part = part if lo is None else part.where(F.col(by) >= lo)
        part = part if hi is None else part.where(F.col(by) < hi)
        part.coalesce(1).write.mode("append").parquet(path)


def test_price_stream_equals_cached_requests(spark, tmp_dir, small_frames):
    registry.load_all()
    fx = lambda n: view(spark, SF_SMALL, n)
    req = fx("fx_price_requests").select("event_id", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("product_id").cast("long").alias("product_id"),
                                         F.col("user_id").cast("long").alias("user_id"), F.col("session_id").cast("string").alias("session_id"))
    first = req.agg(F.min("timestamp") - F.expr("INTERVAL 1 SECOND")).first()[0]
    feats = q_pricing._features(fx).select("session_id", F.lit(first).alias("timestamp"), "intent_probability", "engagement_score", "wtp_estimate")
    comp = q_pricing._snapshot(fx).select(F.col("product_id").cast("long").alias("product_id"), F.lit(first).alias("timestamp"), "min")
    paths = {n: os.path.join(tmp_dir, n) for n in ("req", "feats", "comp")}
    _in_files(req.withColumn("us", F.unix_micros("timestamp")), paths["req"], "us", 3)
    feats.write.parquet(paths["feats"])
    comp.write.parquet(paths["comp"])
    out = so.price_stream(_stream(spark, paths["req"], req.schema), _stream(spark, paths["feats"], feats.schema, 99),
                          _stream(spark, paths["comp"], comp.schema, 99), q_pricing._products(fx), delay="1 hour",
                          feature_ttl_ms=10**12, competitor_ttl_ms=10**12)
    got = _run(out, "k8_out", os.path.join(tmp_dir, "ck"))
    cols = ["event_id", "product_id", "user_id", "variant", "base_price", "final_price", "reason", "discount_pct", "cache_hit"]
    want = registry.QUERIES["i4_cached_prices"](spark, SF_SMALL)
    rows = lambda df: sorted((*[r[c] for c in cols[:4]], *[round(r[c], 4) for c in cols[4:6]], r["reason"], round(r["discount_pct"], 4), r["cache_hit"])
                             for r in df.select(*cols).collect())
    a, b = rows(got), rows(want)
    assert a == b and any(r[-1] for r in a) and not all(r[-1] for r in a)


def test_price_stream_values_go_out_of_date(spark, tmp_dir):
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    req = [(1, 0, 5, 1, "a"), (2, 30, 5, 1, "a"), (3, 61, 5, 1, "a"), (4, 119, 5, 1, "a"), (5, 121, 5, 1, "a"), (6, 122, 5, 2, "b"), (7, 700, 5, 1, "a"),
           (8, 800, 99, 1, "a"), (9, 1500, 5, 3, "a")]
    stamp = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("timestamp", F.to_timestamp("t")).drop("t")
    frames = {"req": stamp([(e, t(s), p, u, x) for e, s, p, u, x in req], "event_id long, t string, product_id long, user_id long, session_id string"),
              "feats": stamp([("a", t(0), .9, .9, 0.), ("a", t(650), .1, .2, 0.)], "session_id string, t string, intent_probability double, engagement_score double, wtp_estimate double"),
              "comp": stamp([(5, t(60), 50.), (5, t(121), 200.)], "product_id long, t string, min double")}
    for n, df in frames.items():
        df.coalesce(1).write.parquet(os.path.join(tmp_dir, n))
    s = {n: _stream(spark, os.path.join(tmp_dir, n), df.schema) for n, df in frames.items()}
    products = spark.createDataFrame([(5, 100.0)], "product_id long, base_price double")
    out = so.price_stream(s["req"], s["feats"], s["comp"], products, delay="2 hours", feature_ttl_ms=600_000, competitor_ttl_ms=600_000)
    got = {r["event_id"]: r for r in _run(out, "k8_old", os.path.join(tmp_dir, "ck")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert [got[e]["cache_hit"] for e in (1, 2, 3, 4, 5, 6, 7, 9)] == [False, True, False, True, False, False, False, False]
    assert got[2]["final_price"] == got[1]["final_price"] and got[4]["final_price"] == got[3]["final_price"]
    assert [got[e]["competitor_min"] for e in (1, 3, 5, 6, 7, 9)] == [None, 50.0, 200.0, 200.0, 200.0, None]
    assert [got[e]["intent_probability"] for e in (1, 3, 6, 7, 9)] == [.9, .9, .05, .1, .05]
