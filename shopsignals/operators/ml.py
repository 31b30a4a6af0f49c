"""Price models on Spark ML.

Boosted trees are trained on the cluster through Spark ML estimators, linear
models from one aggregate (``linear``); nothing is collected to the driver but
model coefficients, sums of products and metric scalars.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.operators import linear
from shopsignals.operators.features import MODEL_FEATURES
from shopsignals.session import materialize

TRAIN_ROWS = 50_000  # training rows that one task holds


@dataclass
class ModelSpec:
    """Boosted-tree settings of the reference's three price models."""
    features: list[str]
    max_iter: int = 100
    max_depth: int = 3
    step_size: float = 0.1
    subsampling_rate: float = 1.0
    min_instances_per_node: int = 1
    feature_subset: str = "all"
    label: str = "target"
    seed: int = 42
    scaler: str = "standard"
    extra: dict = field(default_factory=dict)


# (a) the full pricing model, (b) the time-scenario model, (c) the coarse model
FULL_SPEC = ModelSpec(MODEL_FEATURES, 300, 5, 0.05, 0.8, 5, "sqrt")
TIME_SPEC = ModelSpec(["demand_velocity", "conversion_rate", "hour_of_day", "comp_advantage",
                       "price_vs_comp_avg", "inventory_count", "inventory_urgency", "weighted_wtp"],
                      150, 5, 0.1, label="target_log")
COARSE_SPEC = ModelSpec(["views", "purchases", "cart", "log_demand", "conversion_rate", "cart_ratio"], 100, 3, 0.1)
RIDGE_FEATURES = ["category_code", "subcategory_code", "brand_code", "cost_price_usd", "inventory_count",
                  "avg_rating", "review_count", "weight_kg", "is_active_flag", "launch_year", "tags_count",
                  "price_margin", "inventory_value", "rating_weighted"]


# ------------------------------------------------------------------------- J1
def split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable train/test split by a hash of the key (same rows for
    any partitioning or retry, unlike ``randomSplit`` on unordered input)."""
    b = 10_000
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(b))
    cut = int(round(test_fraction * b))
    return df.where(h >= cut), df.where(h < cut)


def fold_column(df: DataFrame, key: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed + 1)), F.lit(k)).cast("int"))


# ------------------------------------------------------------------- J2, J3, J11
def _scaler(kind: str):
    if kind == "robust":
        return RobustScaler(inputCol="raw_features", outputCol="features", withCentering=True, withScaling=True)
    return StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)


def gbt_pipeline(spec: ModelSpec) -> Pipeline:
    asm = VectorAssembler(inputCols=spec.features, outputCol="raw_features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=spec.label, maxIter=spec.max_iter,
                       maxDepth=spec.max_depth, stepSize=spec.step_size, subsamplingRate=spec.subsampling_rate,
                       minInstancesPerNode=spec.min_instances_per_node, featureSubsetStrategy=spec.feature_subset,
                       seed=spec.seed, **spec.extra)
    return Pipeline(stages=[asm, _scaler(spec.scaler), gbt])


def train_price_model(df: DataFrame, spec: ModelSpec = FULL_SPEC) -> PipelineModel:
    """J2 + J3 (+ J11 with ``scaler='robust'``): scaler fitted on the training rows only.

    Each tree takes several jobs over all partitions, so the rows are written once
    and cut by their own number (``TRAIN_ROWS`` a task), not by how many tasks
    the tables before them took.
    """
    rows = materialize(df.na.fill(0, subset=spec.features))
    return gbt_pipeline(spec).fit(rows.coalesce(max(1, math.ceil(rows.count() / TRAIN_ROWS))))


# ------------------------------------------------------------------------- J7
def regression_metrics(pred: DataFrame, label: str = "target", prediction: str = "prediction",
                       log_space: bool = True) -> DataFrame:
    """R², MAE, RMSE in one aggregate; with ``log_space`` also the MAE
    after expm1 (factor space)."""
    y, p = F.col(label), F.col(prediction)
    # one pass: SS_res / SS_tot = mean squared error / population variance
    aggs = [
        (1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae_log" if log_space else "mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse_log" if log_space else "rmse"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
    ]
    if log_space:
        aggs.append(F.avg(F.abs(F.expm1(y) - F.expm1(p))).alias("mae_factor"))
    return pred.agg(*aggs)


# ------------------------------------------------------------------------- J8
def cross_validate(df: DataFrame, spec: ModelSpec, key: str, folds: int = 5, parallelism: int = 2) -> dict:
    """K-fold R² (mean, std) with a hash fold column."""
    data = fold_column(df.na.fill(0, subset=spec.features), key, folds)
    pipe = gbt_pipeline(spec)
    ev = RegressionEvaluator(labelCol=spec.label, predictionCol="prediction", metricName="r2")
    grid = ParamGridBuilder().build()
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds,
                        foldCol="fold", parallelism=parallelism, seed=spec.seed)
    m = cv.fit(data)
    std = list(getattr(m, "stdMetrics", None) or [float("nan")])
    return {"cv_r2_mean": float(m.avgMetrics[0]), "cv_r2_std": float(std[0])}


# ------------------------------------------------------------------------- J9
def feature_importance(model: PipelineModel, features: list[str]) -> DataFrame:
    """Tree feature importances as a sorted DataFrame."""
    from pyspark.sql import SparkSession

    imp = model.stages[-1].featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return s.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(),
                                                                                  "feature")


# ------------------------------------------------------------------------ J10
def predict_factor(model: PipelineModel, df: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """Predicted price factor for every product (expm1 of the log target)."""
    out = model.transform(df.na.fill(0, subset=features))
    return out.withColumn("predicted_factor", F.expm1("prediction")).drop("raw_features", "features")


# ------------------------------------------------------------------ J5, J6, I8
def train_ridge(df: DataFrame, features: list[str] = RIDGE_FEATURES, label: str = "current_price_usd",
                alpha: float = 10.0) -> PipelineModel:
    """J5 + J6: ridge regression of the current price on catalog features, in
    closed form: NULLs filled by the exact median, features scaled by their sample
    deviation, ||y − Zw||² + alpha·||w||² minimised."""
    fill = linear.median_fill(df, features)
    m = linear.moments(df, features, label, fill).get(0)
    coef = m.fit(alpha) if m else [0.0] * (len(features) + 1)
    return linear.model(features, coef, fill, fill)


def refresh_prices(catalog_features: DataFrame, model: PipelineModel,
                   features: list[str] = RIDGE_FEATURES) -> DataFrame:
    """I8: re-score every SKU in one distributed transform (max(0.01, round 2))."""
    from shopsignals.functions.columns import round_to

    d = catalog_features.select("sku_id", *[F.col(c).cast("double").alias(c) for c in features])
    out = model.transform(d)
    return out.select("sku_id", F.greatest(F.lit(0.01), round_to(F.col("prediction"), 2)).alias("predicted_price"))


# ------------------------------------------------------------------ J4, H13
def train_popularity(df: DataFrame, x=("price", "interaction_count"), label: str = "popularity") -> PipelineModel:
    """Degree-2 polynomial least squares of popularity on (price, interactions)."""
    x = list(x)
    m = linear.moments(df, x, label, products=[(0, 0), (0, 1), (1, 1)]).get(0)
    coef = m.fit() if m else [0.0] * 6
    return linear.model(x, coef, [0.0] * 5, products=[(0, 0), (0, 1), (1, 1)])


def popularity_table(clicks: DataFrame, catalog: DataFrame) -> DataFrame:
    """C5 + D8: catalog ⟕ (popularity, interactions, mean price), one row per SKU
    (of a SKU listed twice the smallest row in column order)."""
    from shopsignals.functions.columns import category_code, event_weight

    agg = (clicks.where(F.col("sku_id").isNotNull()).groupBy("sku_id").agg(
        F.sum(event_weight("event_type", "popularity")).alias("popularity"),
        F.count(F.lit(1)).alias("interaction_count"),
        F.avg("price_seen_usd").alias("price")))
    listed = ["category", "subcategory", "brand", "base_price_usd"]
    c = catalog.groupBy("sku_id").agg(F.min(F.struct(*listed)).alias("_c")).select("sku_id", "_c.*")
    j = c.join(agg, "sku_id", "left")
    return j.select(F.col("sku_id").alias("product_id"), "category", "subcategory",
                    F.coalesce("brand", F.lit("generic")).alias("brand"), "base_price_usd",
                    F.coalesce("popularity", F.lit(0.0)).cast("bigint").alias("popularity"),
                    F.coalesce("interaction_count", F.lit(0)).cast("bigint").alias("interaction_count"),
                    F.coalesce("price", "base_price_usd").alias("price"),
                    category_code("category", "subcategory").alias("category_code"))


def hybrid_scores(pop: DataFrame, model: PipelineModel) -> DataFrame:
    """final = 0.6·predicted + 0.4·popularity."""
    out = model.transform(pop.withColumn("price", F.col("price").cast("double"))
                             .withColumn("interaction_count", F.col("interaction_count").cast("double")))
    return out.withColumn("predicted_score", F.col("prediction")).withColumn(
        "final_score", 0.6 * F.col("predicted_score") + 0.4 * F.col("popularity")).drop("raw", "features",
                                                                                           "prediction")


# ------------------------------------------------------------------ A10
def save_model(model: PipelineModel, path: str) -> None:
    """A10: persist a fitted pipeline (scaler, encoders and model together)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
