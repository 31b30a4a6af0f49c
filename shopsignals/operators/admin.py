"""Admin analytics (D11, D12, D14, D28, D29, E10): global and per-user aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.functions.columns import round_to
from shopsignals.operators.ranks import median
from shopsignals.session import materialize


def total_revenue(orders: DataFrame, total: str = "total") -> DataFrame:
    """Σ order totals (rounded to 2) and the order count."""
    return orders.agg(round_to(F.coalesce(F.sum(total), F.lit(0.0)), 2).alias("total_revenue"),
                      F.count(F.lit(1)).cast("bigint").alias("order_count"))


def kpis(catalog: DataFrame, users: DataFrame, orders: DataFrame, cart_lines: DataFrame,
         events: DataFrame, n_categories: int = 15) -> DataFrame:
    """One KPI row. Each figure is its own scalar aggregate (one small
    job each, results inlined) — no join between the inputs."""
    def scalar(df, expr):
        return df.select(expr).scalar()

    cats = (catalog.where(F.col("category").isNotNull()).select("category").distinct()
            .orderBy("category").limit(n_categories))
    first15 = cats.select(F.array_sort(F.collect_list("category"))).scalar()
    active = events.where(F.col("product_id").isNotNull()).select(F.countDistinct("user_id")).scalar()
    return catalog.sparkSession.range(1).select(
        scalar(catalog, F.count(F.lit(1))).alias("total_products"),
        scalar(users, F.count(F.lit(1))).alias("total_users"),
        scalar(orders, round_to(F.coalesce(F.sum("total"), F.lit(0.0)), 2)).alias("total_revenue"),
        scalar(cart_lines, F.count(F.lit(1))).alias("active_carts"),
        scalar(events, F.count(F.lit(1))).alias("live_events"),
        active.alias("active_sessions"),
        first15.alias("categories"))


def events_by_hour(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Event count per hour of day."""
    return events.where(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour")) \
                 .agg(F.count(F.lit(1)).cast("bigint").alias("events"))


def user_order_totals(orders: DataFrame) -> DataFrame:
    """Per user the number of orders and the amount spent."""
    return orders.groupBy("email").agg(F.count(F.lit(1)).cast("bigint").alias("total_orders"),
                                       F.sum("total").alias("total_spent"))


def rfm(orders: DataFrame, as_of, date_col: str = "created_at") -> DataFrame:
    """Recency (days since the last order), frequency (orders),
    monetary (Σ totals); high_spender when monetary ≥ the median over users.

    The median is one scalar, selected by rank over range-split totals.
    """
    t = F.lit(as_of).cast("date")
    per = materialize(orders.groupBy("email").agg(
        F.datediff(t, F.max(F.col(date_col)).cast("date")).alias("recency"),
        F.countDistinct("order_id").cast("bigint").alias("frequency"),
        F.sum("total").alias("monetary")))
    med = median(per, "monetary")
    return per.withColumn("segment", F.when(F.col("monetary") >= med, "high_spender").otherwise("low_spender"))


def recent_totals(orders: DataFrame, n: int = 8, date_col: str = "created_at", key: str = "order_id") -> DataFrame:
    """The last n order totals, oldest first (position 1 = oldest)."""
    last = orders.orderBy(F.col(date_col).desc(), F.col(key).desc()).limit(n)
    return last.withColumn("position", F.row_number().over(Window.orderBy(F.col(date_col), F.col(key)))) \
               .select("position", key, "total")
