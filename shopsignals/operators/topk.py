"""Exact per-group top-k without a window over a whole group.

Stage 1 ranks inside (group, salt) slices — the salt is a hash of the row —
and keeps k rows per slice; stage 2 ranks the at most ``salts × k`` survivors
of each group. The top k of a group is contained in the union of its slices'
top k, so the result is exact for any total order (every order used here ends
in a unique key). A group holding a third of all rows is cut down by many
tasks in parallel instead of being sorted by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SALTS = 16


def top_k_per_group(df: DataFrame, keys: list, order: list, k: int, name: str = "rank",
                    salts: int = DEFAULT_SALTS) -> DataFrame:
    """Rows ranked 1..k within each ``keys`` group by ``order`` (rank in ``name``)."""
    keys = list(keys)
    if not keys:
        top = df.orderBy(*order).limit(k)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    s1 = (df.withColumn("_salt", salt)
            .withColumn("_r1", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
            .where(F.col("_r1") <= k).drop("_salt", "_r1"))
    return s1.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) \
             .where(F.col(name) <= k)


def first_per_group(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each group in ``order`` as an aggregate (``min_by`` over
    a struct of the row), so it is combined map-side like any aggregate."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    okey = F.struct(*[(o if not isinstance(o, str) else F.col(o)) for o in order])
    row = F.min_by(F.struct(*[F.col(c) for c in others]), okey).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
