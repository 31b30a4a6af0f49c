"""Fairness audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.functions.columns import round_to
from shopsignals.operators.ranks import median
from shopsignals.session import materialize

DEMOGRAPHIC = ("gender", "age_group", "country")


def user_classes(clicks: DataFrame) -> DataFrame:
    """Behaviour class per user with events: browser (no purchase),
    premium (mean purchase price ≥ 200), regular (≥ 50), low_spender."""
    is_p = F.col("event_type") == "purchase"
    g = clicks.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count_if(is_p).alias("_np"),
        F.sum(F.when(is_p, F.col("price_seen_usd"))).alias("_sp"))
    aov = F.col("_sp") / F.col("_np")
    cls = (F.when(F.col("_np") == 0, "browser").when(aov >= 200, "premium")
            .when(aov >= 50, "regular").otherwise("low_spender"))
    return g.select("user_id", cls.alias("calculated_segment"))


def segment_users(clicks: DataFrame, users: DataFrame) -> DataFrame:
    """D16 + C6: every user with a class; users without events are new_user."""
    j = users.join(user_classes(clicks), "user_id", "left")
    return j.withColumn("calculated_segment", F.coalesce("calculated_segment", F.lit("new_user")))


def segment_crosstab(users: DataFrame, by: str, col: str = "calculated_segment") -> DataFrame:
    """Row-normalised crosstab in long form: (by, segment, pct)."""
    c = users.where(F.col(by).isNotNull() & F.col(col).isNotNull()).groupBy(by, col) \
             .agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(by).agg(F.sum("n").alias("_t"))
    return c.join(tot, by).select(by, F.col(col).alias("segment"), "n",
                                  (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def audit_prices(prices: DataFrame) -> DataFrame:
    """Markup and savings per audited product: (product_id, markup_pct, savings_pct)."""
    return prices.select("product_id",
                         (F.try_divide(F.col("final_price") - F.col("base_price"), F.col("base_price")) * 100)
                         .alias("markup_pct"),
                         F.col("savings_percent").alias("savings_pct"))


def parity_report(users: DataFrame, prices: DataFrame, dims=("gender", "age_group", "segment_assigned")) -> DataFrame:
    """C7 + D18: mean markup % and savings % per demographic group over the
    audit grid users × audited products.

    Prices ignore the user (rule Q8), so a group's mean over its cells equals
    the mean over the products. The grid is never materialised: per group we
    count users, and the product means are one scalar subquery.
    Output (dimension, value, n_users, n_cells, markup_pct, savings_pct),
    means rounded to 2.
    """
    ap = audit_prices(prices)
    stats = ap.select(F.struct(F.avg("markup_pct").alias("m"), F.avg("savings_pct").alias("s"),
                               F.count(F.lit(1)).alias("p")).alias("x")).scalar()
    u = users
    if "segment_assigned" in dims and "segment_assigned" not in u.columns:
        u = u.withColumn("segment_assigned", F.lit("anonymous"))  # the price service's segment
    g = u.groupingSets([[d] for d in dims], *dims).agg(F.count(F.lit(1)).alias("n_users"),
                                                       F.grouping_id().alias("_gid"))
    # grouping_id has a 1-bit for every column not grouped in the row's set
    n, key = len(dims), None
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        e = F.when(F.col("_gid") == gid,
                   F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")))
        key = e if key is None else key.when(F.col("_gid") == gid, e)
    exprs = key
    return g.select(exprs.alias("k"), "n_users").select(
        "k.dimension", "k.value", F.col("n_users").cast("bigint").alias("n_users"),
        (F.col("n_users") * stats["p"]).cast("bigint").alias("n_cells"),
        round_to(stats["m"], 2).alias("markup_pct"), round_to(stats["s"], 2).alias("savings_pct"))


def factor_stats(df: DataFrame, col: str = "price_factor") -> DataFrame:
    """Mean, median, min, max, sample std and range of a column."""
    c, df = F.col(col), materialize(df.select(col))
    return df.agg(F.avg(c).alias("mean"), F.first(median(df, col)).alias("median"), F.min(c).alias("min"),
                  F.max(c).alias("max"), F.stddev_samp(c).alias("std"), (F.max(c) - F.min(c)).alias("range"),
                  F.count(c).cast("bigint").alias("count"))


def demographic_leak(spark, features: list[str]) -> DataFrame:
    """The demographic attributes among the model's features (expected none)."""
    leak = sorted(set(DEMOGRAPHIC) & set(features))
    return spark.createDataFrame([(",".join(leak), len(leak) == 0, len(features))],
                                 "demographic_features_used string, is_fair boolean, n_features int")
