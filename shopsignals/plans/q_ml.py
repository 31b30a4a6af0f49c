"""Registered queries: Spark ML price models (rows-only where a model is fitted)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsignals.operators import catalog as ct
from shopsignals.operators import features as ft
from shopsignals.operators import linear, ml
from shopsignals.operators import pricing as pr
from shopsignals.plans.q_features import TARGET_SQL
from shopsignals.plans.registry import query
from shopsignals.session import input_state

FX4 = ("fx_clickstream", "fx_catalog", "fx_competitor", "fx_profiles")


def _features(fx):
    return ft.product_features(fx("fx_clickstream"), fx("fx_catalog"), fx("fx_competitor"), fx("fx_profiles"),
                               keep_target=True)


_MODELS: dict = {}


def _full_model(fx):
    """The full model is fitted once per application and state of its input files
    (names, sizes, times) and shared by the queries that read it (predictions,
    metrics, importances)."""
    f = _features(fx)
    key = (f.sparkSession.sparkContext.applicationId, *[input_state(fx(t)) for t in ("events", "part", "lineitem", "customer")])
    if key not in _MODELS:
        train, _ = ml.split(f, "product_id", 0.2, 42)
        _MODELS[key] = ml.train_price_model(train, ml.FULL_SPEC)
    return f, _MODELS[key]


@query("j10_predict_factor", "product_id:i predicted_factor:d price_factor:d")
def j10(fx):
    """J1–J3 + J10: boosted trees (300 × depth 5) on the 31 features; predicted factor for every product."""
    f, m = _full_model(fx)
    return ml.predict_factor(m, f)


@query("j7_model_metrics", "r2:d mae_log:d rmse_log:d mae_factor:d n:i")
def j7m(fx):
    """Test-split metrics of the full price model."""
    f, m = _full_model(fx)
    _, test = ml.split(f, "product_id", 0.2, 42)
    return ml.regression_metrics(m.transform(test.na.fill(0, subset=ft.MODEL_FEATURES)))


@query("j9_feature_importance", "feature:s importance:d")
def j9(fx):
    """Sorted feature importances of the full price model."""
    _, m = _full_model(fx)
    return ml.feature_importance(m, ft.MODEL_FEATURES)


@query("j7_metrics_coarse_vs_full", "r2:d mae_log:d rmse_log:d n:i mae_factor:d", views=FX4, oracle=f"""
WITH t AS ({TARGET_SQL}),
 c AS (SELECT sku_id, ln(1 + least(greatest(1 + 0.5 * (count_if(event_type = 'purchase') / (count_if(event_type IS NULL OR event_type NOT IN
  ('add_to_cart', 'add_to_wishlist', 'checkout_start', 'purchase')) + 1))
  + 0.3 * (count_if(event_type IN ('add_to_cart', 'add_to_wishlist', 'checkout_start')) / (count_if(event_type IS NULL OR event_type NOT IN
  ('add_to_cart', 'add_to_wishlist', 'checkout_start', 'purchase')) + 1)), 0.7), 1.5)) AS prediction
  FROM fx_clickstream WHERE sku_id IS NOT NULL GROUP BY sku_id),
 j AS (SELECT t.target, c.prediction FROM t JOIN c ON t.sku_id = c.sku_id)
SELECT 1 - avg((target - prediction) * (target - prediction)) / var_pop(target) AS r2, avg(abs(target - prediction)) AS mae_log,
 sqrt(avg((target - prediction) * (target - prediction))) AS rmse_log, count(*) AS n,
 avg(abs((exp(target) - 1) - (exp(prediction) - 1))) AS mae_factor FROM j""")
def j7(fx):
    """J7 given predictions: how well the coarse factor (D10) predicts the full target."""
    f = _features(fx).select("product_id", "target")
    leg = ct.legacy_events(fx("fx_clickstream"), fx("fx_catalog"))
    c = ft.coarse_price_factor(ft.coarse_demand(leg)).select("product_id", F.col("target").alias("prediction"))
    return ml.regression_metrics(f.join(c, "product_id"))


@query("j10_coarse_model", "product_id:i prediction:d")
def j10c(fx):
    """J3 (c): the coarse six-feature model on the legacy export."""
    leg = ct.legacy_events(fx("fx_clickstream"), fx("fx_catalog"))
    d = ft.coarse_price_factor(ft.coarse_demand(leg))
    m = ml.train_price_model(d, ml.COARSE_SPEC)
    return m.transform(d).select("product_id", "prediction")


@query("j3_time_model", "product_id:i hour_of_day:i prediction:d")
def j3t(fx):
    """J3 (b): the time-scenario model (150 trees) on the I10 table."""
    ts = ft.time_scenarios(_features(fx))
    m = ml.train_price_model(ts, ml.TIME_SPEC)
    return m.transform(ts.na.fill(0, subset=ml.TIME_SPEC.features)).select("product_id", "hour_of_day", "prediction")


def _solved_sql(x: str, n: int, alpha: float, train: str = "true") -> str:
    """CTEs (after ``x``: id, f1 .. fn, y) that solve least squares on the scaled
    features of the rows ``train`` by Gauss-Jordan steps; ``pr`` (z's columns and
    prediction) holds every row's prediction."""
    f = range(1, n + 1)
    avg = ", ".join(f"avg(f{i}) AS a{i}, coalesce(nullif(stddev_samp(f{i}), 0), 1e300) AS d{i}" for i in f)
    z = ", ".join(f"(f{i} - a{i}) / d{i} AS z{i}" for i in f)
    rows = ", ".join("[" + ", ".join([*(f"sum(z{i} * z{j})" + (f" + {alpha}" if i == j else "") for j in f), f"sum(z{i} * yc)"]) + "]" for i in f)
    return f"""x AS ({x}), st AS (SELECT avg(y) AS ay, {avg} FROM x WHERE {train}), z AS (SELECT x.*, ay, y - ay AS yc, {z} FROM x, st),
 g(k, m) AS (SELECT 1, [{rows}] FROM z WHERE {train}
  UNION ALL SELECT k + 1, [CASE WHEN i = k THEN [v / m[k][k] FOR v IN m[k]] ELSE [m[i][j] - m[i][k] * m[k][j] / m[k][k] FOR j IN range(1, {n + 2})] END
   FOR i IN range(1, {n + 1})] FROM g WHERE k <= {n}),
 pr AS (SELECT z.*, ay + {' + '.join(f'm[{i}][{n + 1}] * z{i}' for i in f)} AS prediction FROM z, g WHERE k = {n + 1})"""


# the ridge model's 14 features, nulls filled by the median
_RIDGE_SQL = r"""
WITH b AS (SELECT sku_id AS id, current_price_usd AS y, dense_rank() OVER (ORDER BY coalesce(category, 'Unknown')) - 1 AS f1,
  dense_rank() OVER (ORDER BY coalesce(subcategory, 'Unknown')) - 1 AS f2, dense_rank() OVER (ORDER BY coalesce(brand, 'Unknown')) - 1 AS f3,
  cost_price_usd AS f4, inventory_count AS f5, avg_rating AS f6, review_count AS f7, weight_kg AS f8, CASE WHEN upper(is_active) = 'TRUE' THEN 1 ELSE 0 END AS f9,
  year(try_strptime(launch_date, '%d/%m/%y')) AS f10,
  CASE WHEN regexp_matches(tags, '^\s*\[.*\]\s*$') THEN len(regexp_extract_all(tags, '''[^'']*''|"[^"]*"')) ELSE 0 END AS f11,
  base_price_usd - cost_price_usd AS f12, inventory_count * cost_price_usd AS f13, avg_rating * review_count AS f14 FROM fx_catalog)
SELECT id, y, """ + ", ".join(f"CAST(coalesce(f{i}, (SELECT median(f{i}) FROM b)) AS DOUBLE) AS f{i}" for i in range(1, 15)) + " FROM b"
_RIDGE_FIT_SQL = f"WITH RECURSIVE {_solved_sql(_RIDGE_SQL, 14, 10.0)}"
_REPRICED_SQL = _RIDGE_FIT_SQL + " SELECT id AS sku_id, greatest(0.01, round(prediction * 100.0) / 100.0) AS predicted_price FROM pr"


def _ridge_inputs(fx):
    c = ct.label_encode(ct.price_model_features(fx("fx_catalog"), year_fill="median"),
                        ["category", "subcategory", "brand"])
    return c


@query("i8_refresh_prices", "sku_id:i predicted_price:d", views=("fx_catalog",), oracle=_REPRICED_SQL)
def i8(fx):
    """J5 + J6 + I8: ridge (α = 10) price model, every SKU re-scored in one transform."""
    c = _ridge_inputs(fx)
    m = ml.train_ridge(c)
    return ml.refresh_prices(c, m)


@query("j8_ridge_folds", "fold:i n:i r2:d", views=("fx_catalog",), oracle=" UNION ALL ".join(f"""
SELECT * FROM (WITH RECURSIVE {_solved_sql(f"SELECT *, CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':43'), 1, 8) AS BIGINT) % 5 AS fold FROM ({_RIDGE_SQL})", 14, 10.0, f"fold <> {k}")}
 SELECT {k} AS fold, count(*) AS n, 1 - avg((y - prediction) * (y - prediction)) / var_pop(y) AS r2 FROM pr WHERE fold = {k})""" for k in range(5)))
def j8(fx):
    """R² of the ridge model on each of five folds left out, all from one pass."""
    c = _ridge_inputs(fx)
    return linear.cross_validate_ridge(c, ml.RIDGE_FEATURES, "current_price_usd", 10.0,
                                       "conv(substr(md5(cast(concat(cast(sku_id as string), ':43') as binary)), 1, 8), 16, 10) % 5")


@query("i6_catalog_price_ml", "product_id:i base_price:d final_price:d savings_percent:d ml_factor:d", views=("fx_catalog_active",),
       oracle=f"""
WITH p AS ({_REPRICED_SQL}),
 b AS (SELECT c.sku_id, coalesce(base_price_usd, 0) AS base, coalesce(current_price_usd, base_price_usd, 0) AS cur, p.predicted_price AS pred,
  coalesce(inventory_count, 0) AS inv, coalesce(avg_rating, 0) AS rating, coalesce(review_count, 0) AS reviews
  FROM fx_catalog_active c LEFT JOIN p ON c.sku_id = p.sku_id),
 m AS (SELECT *, least(greatest(CASE WHEN cur > 0 THEN coalesce(pred, cur) / cur ELSE 1.0 END, 0.7), 1.5) AS ml,
  CASE WHEN inv < 20 THEN 1.08 WHEN inv > 500 THEN 0.95 ELSE 1.0 END AS ia,
  CASE WHEN rating >= 4.5 AND reviews > 100 THEN 1.05 WHEN rating < 2.5 AND reviews > 20 THEN 0.92 ELSE 1.0 END AS ra FROM b),
 f AS (SELECT *, round(greatest(cur * ml * ia * ra, base * 0.70) * 100.0) / 100.0 AS final_price FROM m)
SELECT sku_id AS product_id, round(cur * 100.0) / 100.0 AS base_price, final_price, round(ml * 10000.0) / 10000.0 AS ml_factor,
 CASE WHEN cur > 0 THEN round(round((cur - final_price) * 100.0) / 100.0 / cur * 100 * 10.0) / 10.0 ELSE 0.0 END AS savings_percent FROM f""")
def i6m(fx):
    """I6 with the ridge model's predictions as the ML factor."""
    c = _ridge_inputs(fx)
    preds = ml.refresh_prices(c, ml.train_ridge(c))
    return pr.catalog_price(ct.clean_catalog(fx("fx_catalog")), preds, as_of_date="2024-01-01")


_POPULARITY_SQL = """
SELECT c.sku_id AS product_id, coalesce(c.brand, 'generic') AS brand, CAST(coalesce(a.popularity, 0) AS BIGINT) AS popularity,
 coalesce(a.n, 0) AS interaction_count, coalesce(a.price, c.base_price_usd) AS price,
 replace(replace(lower(c.category), ' & ', '_'), ' ', '_') || '.' || replace(replace(lower(c.subcategory), ' & ', '_'), ' ', '_') AS category_code
FROM fx_catalog c LEFT JOIN (SELECT sku_id, sum(CASE event_type WHEN 'page_view' THEN 1 WHEN 'product_view' THEN 2
 WHEN 'search' THEN 1 WHEN 'add_to_cart' THEN 3 WHEN 'add_to_wishlist' THEN 2 WHEN 'checkout_start' THEN 4
 WHEN 'purchase' THEN 5 WHEN 'remove_from_cart' THEN 0 WHEN 'page_exit' THEN 0 ELSE 1 END) AS popularity,
 count(*) AS n, avg(price_seen_usd) AS price FROM fx_clickstream WHERE sku_id IS NOT NULL GROUP BY sku_id) a
 ON c.sku_id = a.sku_id"""


@query("c5_popularity_table", "product_id:i brand:s popularity:i interaction_count:i price:d category_code:s",
       views=("fx_clickstream", "fx_catalog"), oracle=_POPULARITY_SQL)
def c5(fx):
    """C5 + D8: popularity table for the hybrid model."""
    return ml.popularity_table(fx("fx_clickstream"), fx("fx_catalog"))


_POLY_SQL = (f"SELECT product_id AS id, popularity, CAST(popularity AS DOUBLE) AS y, price AS f1, price * price AS f2, CAST(interaction_count AS DOUBLE) AS f3, "
             f"price * interaction_count AS f4, CAST(interaction_count * interaction_count AS DOUBLE) AS f5 FROM ({_POPULARITY_SQL})")


@query("h13_hybrid_popularity", "product_id:i popularity:i predicted_score:d final_score:d", views=("fx_clickstream", "fx_catalog"),
       oracle=f"WITH RECURSIVE {_solved_sql(_POLY_SQL, 5, 0.0)} SELECT id AS product_id, popularity, prediction AS predicted_score, "
              "0.6 * prediction + 0.4 * popularity AS final_score FROM pr")
def h13(fx):
    """J4 + H13: polynomial popularity model and the 0.6/0.4 hybrid score."""
    pop = ml.popularity_table(fx("fx_clickstream"), fx("fx_catalog"))
    return ml.hybrid_scores(pop, ml.train_popularity(pop))
