"""Exact selection by rank: medians, the first n rows, samples of exactly n rows.

No task sees more than its share. Medians come from counts of equal values,
range split over tasks: one count a partition tells which partition holds a
rank, and only that one is looked at. The n-th smallest of whole numbers comes
from mergeable histograms of BINS counts, each of which cuts the range that
holds it by that factor; rows are read but never exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.session import materialize

BINS = 4096


def medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the exact median of each column (mean of the two middle
    values; NULLs do not count; NULL without values)."""
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols]))
    counts = df.select(value.alias("x")).select("x.*").where("v is not null").groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    split = materialize(counts.repartitionByRange("name", "v").withColumn("_pid", F.spark_partition_id()))
    whole = Window.partitionBy("name")
    parts = (split.groupBy("name", "_pid").agg(F.sum("n").alias("_c"))
             .withColumn("_upto", F.sum("_c").over(whole.orderBy("_pid"))).withColumn("_all", F.sum("_c").over(whole)))
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))))
    held = (parts.withColumn("_rank", middle).withColumn("_off", F.col("_upto") - F.col("_c"))
            .where("_off <= _rank and _rank < _upto").select("name", "_pid", "_rank", "_off"))
    # two rows a column: the partition of each middle rank
    inside = split.join(F.broadcast(held), ["name", "_pid"])
    upto = F.col("_off") + F.sum("n").over(Window.partitionBy("name", "_pid", "_off", "_rank").orderBy("v"))
    found = inside.withColumn("_upto", upto).where("_rank < _upto and _rank >= _upto - n")
    return found.agg(*[F.avg(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in cols])


def median(df: DataFrame, col: str) -> Column:
    """The exact median of a column as a scalar."""
    return medians(df, [col]).scalar()


def nth_smallest(df: DataFrame, whole_number: Column, n: int) -> tuple[int, int] | None:
    """(the n-th smallest value, how many rows are smaller); None for fewer rows."""
    x = df.select(whole_number.cast("long").alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("rows")).first()
    if n < 1 or ends["rows"] < n:
        return None
    lo, hi, below = int(ends["lo"]), int(ends["hi"]), 0
    while lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        kind = "long" if hi - lo < 1 << 62 else "decimal(20,0)"  # a wider range overflows
        at = (F.col("x").cast(kind) - F.lit(lo).cast(kind)) / F.lit(width).cast(kind) if kind != "long" else \
            F.expr(f"(x - ({lo})) div {width}L")
        bins = x.where(F.col("x").between(lo, hi)).groupBy(F.floor(at).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("c"))
        upto = bins.withColumn("u", F.sum("c").over(Window.orderBy("b")))  # at most BINS rows
        b = upto.where(F.col("u") >= n - below).orderBy("b").select("b", (F.col("u") - F.col("c")).alias("before")).first()
        below += int(b["before"])
        lo, hi = lo + int(b["b"]) * width, min(hi, lo + (int(b["b"]) + 1) * width - 1)
    return lo, below


def smallest(df: DataFrame, whole_number: Column, n: int, ties: list[Column]) -> DataFrame:
    """The ``n`` rows with the smallest values (all that have one, if fewer); of
    rows with the last value the first ones by ``ties``."""
    cut = nth_smallest(df, whole_number, n)
    if cut is None:
        return df.where(whole_number.isNotNull()).limit(0) if n < 1 else df.where(whole_number.isNotNull())
    value, below = cut
    return df.where(whole_number < value).unionByName(df.where(whole_number == value).orderBy(*ties).limit(n - below))


def hash_number(key: Column, seed: int) -> Column:
    """60 bits of md5(key ":" seed) as a whole number: the same in any engine."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
