"""J8 cross-validation, J11 robust scaling, I7 daily price table, K1 de-duplication."""

import os

from pyspark.sql import functions as F

from shopsignals.operators import features as ft
from shopsignals.operators import ml
from shopsignals.operators import pricing as pr
from shopsignals.sources import sinks
from shopsignals.sources.fixtures import view
from shopsignals.streaming import operators as so
from shopsignals.streaming import sources as src
from tests.conftest import SF_SMALL


def _features(spark):
    fx = lambda n: view(spark, SF_SMALL, n)
    return ft.product_features(fx("fx_clickstream"), fx("fx_catalog"), fx("fx_competitor"), fx("fx_profiles"),
                               keep_target=True)


def test_cross_validation_and_robust_scaler(spark):
    f = _features(spark)
    spec = ml.ModelSpec(ml.MODEL_FEATURES, max_iter=5, max_depth=3, step_size=0.1)
    cv = ml.cross_validate(f, spec, "product_id", folds=3)
    assert -10 < cv["cv_r2_mean"] <= 1.0
    robust = ml.ModelSpec(ml.MODEL_FEATURES, max_iter=5, max_depth=3, scaler="robust")
    m = ml.train_price_model(f, robust)
    out = ml.predict_factor(m, f)
    assert out.count() == f.count()
    assert out.where(F.col("predicted_factor").isNull()).count() == 0
    imp = ml.feature_importance(m, ml.MODEL_FEATURES).collect()
    assert len(imp) == 31 and abs(sum(r["importance"] for r in imp) - 1.0) < 1e-6


def test_training_plan_writes_all_artifacts(spark, tmp_dir):
    from shopsignals.plans.training import run_training

    fx = lambda n: view(spark, SF_SMALL, n)
    spec = ml.ModelSpec(ml.MODEL_FEATURES, max_iter=5, max_depth=3, step_size=0.1, subsampling_rate=0.8,
                        min_instances_per_node=5, feature_subset="sqrt")
    rep = run_training(fx("fx_clickstream"), fx("fx_catalog"), fx("fx_competitor"), fx("fx_profiles"),
                       tmp_dir, spec, cv_folds=3)
    assert rep["fairness"]["is_fair"] and rep["datasets"]["products_with_features"] > 0
    assert 0.7 - 0.5 < rep["fairness"]["price_factor_stats"]["mean"] < 1.5 + 0.5
    for name in ("model", "pricing_data", "user_segment_wtp", "category_recs", "rules", "legacy_events",
                 "training_report"):
        assert os.path.isdir(os.path.join(tmp_dir, name)), name
    assert "predicted_factor" in spark.read.parquet(os.path.join(tmp_dir, "pricing_data")).columns


def test_time_scenario_training(spark, tmp_dir):
    from shopsignals.plans.training import run_time_scenario_training

    spec = ml.ModelSpec(ml.TIME_SPEC.features, max_iter=5, max_depth=3, step_size=0.1, label="target_log")
    m = run_time_scenario_training(_features(spark), tmp_dir, spec)
    assert m["test_rows"] % 4 == 0 and m["test_rows"] > 0  # a product's four scenarios stay together
    assert os.path.isdir(os.path.join(tmp_dir, "time_model"))


def test_session_recommender_holdout(spark):
    from shopsignals.plans.training import run_session_recommender

    fx = lambda n: view(spark, "/root/testdata/sf0.01", n)
    m = run_session_recommender(fx("fx_clickstream"), fx("fx_catalog"))
    assert m["val_samples"] > 0
    assert 0.0 <= m["mrr_at_k"] <= m["hit_rate_at_k"] <= 1.0


def test_daily_price_table_partitioned(spark, tmp_dir):
    cat = view(spark, SF_SMALL, "fx_catalog")
    path = os.path.join(tmp_dir, "daily")
    for day in ("2024-01-01", "2024-01-02"):
        sinks.write_table(pr.daily_prices(cat, day), path, partition_by=["cache_date"], mode="append")
    back = spark.read.parquet(path)
    assert sorted(str(r["cache_date"]) for r in back.select("cache_date").distinct().collect()) == \
        ["2024-01-01", "2024-01-02"]
    one_day = back.where(F.col("cache_date").cast("string") == "2024-01-02")
    assert one_day.count() == cat.count()


def test_valid_clicks_drops_replayed_events(spark, tmp_dir):
    clicks = view(spark, SF_SMALL, "fx_live_clicks").select(
        "event_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "user_id",
        F.col("session_id").cast("string").alias("session_id"), "product_id", "event_type")
    d = os.path.join(tmp_dir, "clicks")
    clicks.write.parquet(d)
    clicks.where(F.col("event_id") % 2 == 0).write.mode("append").parquet(d)  # a replay of half the events
    ok, bad = so.valid_clicks(src.click_stream(spark, d))
    q = (ok.writeStream.format("memory").queryName("k1_ok").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("k1_ok")
    want = clicks.where(F.col("event_type").isin("page_view", "search", "cart", "purchase", "wishlist")
                        & F.col("session_id").isNotNull())
    assert got.count() == want.count()
    assert got.select("event_id").distinct().count() == got.count()
