"""Baskets, pair counts and association rules.

Scale notes
-----------
* Baskets stay in long form ``(basket, item)``; nothing is collected per basket.
* Pair generation is the only super-linear step. Each basket is split into
  chunks of at most ``chunk_items`` items (by a hash of the item) and every
  (chunk i ≤ chunk j) block of a basket is its own join key, so one hot basket
  is spread over many tasks instead of producing all its pairs in one task.
  Nothing is capped or sampled: every pair of every basket is counted.
* Apriori pruning is exact: a pair can only reach ``min_support`` when both
  items do, so items below it are removed before pairing.
* Pair counts aggregate with map-side partial aggregation.
* Each step runs in as many tasks as its input, or its counted pairs, need, so
  that a task's sorts and hash tables stay as they are when the tables grow.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.functions.columns import round_to
from shopsignals.session import materialize_small, small_tasks, tasks_for

TASK_PAIRS = 500_000  # pairs that one task counts


# ------------------------------------------------------------------------ D20
def baskets(events: DataFrame, key: str, item: str, types: list[str] | None = None,
            type_col: str = "event_type") -> DataFrame:
    """Long-form baskets (basket, item) from events, optional type filter."""
    ev = events
    if types is not None:
        ev = ev.where(F.col(type_col).isin(list(types)))
    return (ev.where(F.col(key).isNotNull() & F.col(item).isNotNull())
              .select(F.col(key).alias("basket"), F.col(item).alias("item")))


# ------------------------------------------------------------------------ D21
def filter_baskets(b: DataFrame, min_count: int = 5, min_items: int = 2) -> DataFrame:
    """Drop items seen fewer than ``min_count`` times (duplicates count),
    dedupe items within a basket, keep baskets with ≥ ``min_items`` items."""
    b = materialize_small(b)  # read twice
    frequent = b.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count)
    kept = materialize_small(b.join(frequent.select("item"), "item", "left_semi").distinct())
    sizes = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("basket_size")) \
                .where(F.col("basket_size") >= min_items)
    return materialize_small(kept.join(sizes, "basket", "inner"))


# ------------------------------------------------------------------- C10, D22
def item_pairs(b: DataFrame, chunk_items: int = 1024, min_pair_count: int = 1) -> DataFrame:
    """C10 + D22: (item_a, item_b, n_ab) over baskets, item_a < item_b.

    ``b`` carries (basket, item, basket_size) with distinct items per basket.
    """
    out = _pair_counts(materialize_small(b), chunk_items)
    return out.where(F.col("n_ab") >= min_pair_count) if min_pair_count > 1 else out


def _pair_counts(b: DataFrame, chunk_items: int, carry: str | None = None) -> DataFrame:
    """(item_a, item_b, n_ab) of a written ``b``, with the column ``carry`` of both
    items where given (one value an item)."""
    own = F.col("item").alias("i"), *([F.col(carry).alias("c")] if carry else [])
    nchunks = F.greatest(F.lit(1), F.ceil(F.col("basket_size") / F.lit(chunk_items))).cast("int")
    x = b.withColumn("_s", nchunks)
    x = x.withColumn("_c", F.pmod(F.xxhash64(F.col("item")), F.col("_s")).cast("int"))
    left = x.select("basket", F.col("_c").alias("bi"),
                    F.explode(F.sequence(F.col("_c"), F.col("_s") - 1)).alias("bj"),
                    F.struct(*own).alias("a"))
    right = x.select("basket", F.explode(F.sequence(F.lit(0), F.col("_c"))).alias("bi"),
                     F.col("_c").alias("bj"), F.struct(*own).alias("b"))
    j = left.join(right, ["basket", "bi", "bj"], "inner")
    j = j.where((F.col("bi") < F.col("bj")) | (F.col("a.i") < F.col("b.i")))
    up = F.col("a.i") < F.col("b.i")
    low, high = F.when(up, F.col("a")).otherwise(F.col("b")), F.when(up, F.col("b")).otherwise(F.col("a"))
    ends = [e.getField(f).alias(n + x) for f, n in (("i", "item_"), ("c", "carry_"))[:len(own)] for e, x in ((low, "a"), (high, "b"))]
    pairs = j.select(*ends)
    out = pairs.groupBy(*pairs.columns).agg(F.count(F.lit(1)).alias("n_ab"))
    with small_tasks(b.sparkSession, tasks_for(b)):
        n = b.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    return materialize_small(out, math.ceil((n or 0) / TASK_PAIRS))


def item_counts(b: DataFrame) -> DataFrame:
    """Number of (filtered) baskets holding each item."""
    return b.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))


# ------------------------------------------------------------------------- H1
def association_rules(b: DataFrame, min_support: float = 0.0003, min_confidence: float = 0.02,
                      chunk_items: int = 1024) -> DataFrame:
    """H1/H2/H3: single-antecedent rules from filtered baskets (D21 output).

    support = n_ab / N, confidence = support / supp(antecedent),
    lift = confidence / supp(consequent); both directions; rounded 4/4/6.
    """
    # b feeds the basket count, the item counts and the pairs: compute it once
    return _rules(materialize_small(b), min_support, min_confidence, chunk_items)


def _rules(b: DataFrame, min_support: float, min_confidence: float, chunk_items: int = 1024) -> DataFrame:
    """``association_rules`` of a written ``b``."""
    with small_tasks(b.sparkSession, tasks_for(b)):
        n = F.lit(b.select(F.countDistinct("basket")).first()[0])
    # exact Apriori pruning: n_a ≥ n_ab ≥ min_support·N; the counts go with the items, so the pairs join nothing
    frequent = item_counts(b).where(F.col("n_item") / n >= F.lit(min_support))
    pairs = _pair_counts(materialize_small(b.join(frequent, "item")), chunk_items, "n_item")
    p = (pairs.withColumn("support", F.col("n_ab") / n).where(F.col("support") >= F.lit(min_support))
         .withColumn("supp_a", F.col("carry_a") / n).withColumn("supp_b", F.col("carry_b") / n))
    # both directions from one row: the pairs are counted once
    ways = [F.struct(F.col(f"item_{x}").alias("ant"), F.col(f"item_{y}").alias("con"),
                     (F.col("support") / F.col(f"supp_{x}")).alias("confidence"), F.col(f"supp_{y}").alias("supp_con"))
            for x, y in ("ab", "ba")]
    r = p.select("support", F.inline(F.array(*ways))).where(F.col("confidence") >= F.lit(min_confidence))
    return r.select(F.col("ant").cast("string").alias("antecedents"),
                    F.col("con").cast("string").alias("consequents"),
                    round_to(F.col("confidence"), 4).alias("confidence"),
                    round_to(F.col("confidence") / F.col("supp_con"), 4).alias("lift"),
                    round_to(F.col("support"), 6).alias("support"))


def rules_from_events(events: DataFrame, key: str, item: str, types=None, min_count: int = 5,
                      min_support: float = 0.0003, min_confidence: float = 0.02) -> DataFrame:
    """D20 → D21 → H1 in one call."""
    return _rules(filter_baskets(baskets(events, key, item, types), min_count), min_support, min_confidence)


def fpgrowth_pairs(b: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """H2 cross-check with Spark ML FPGrowth, filtered to 1 → 1 rules.

    FPGrowth mines itemsets of every length, so keep it to test-sized data;
    ``association_rules`` is the production path.
    """
    from pyspark.ml.fpm import FPGrowth

    items = b.groupBy("basket").agg(F.collect_set(F.col("item").cast("string")).alias("items"))
    m = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    r = m.associationRules.where((F.size("antecedent") == 1) & (F.size("consequent") == 1))
    return r.select(F.col("antecedent")[0].alias("antecedents"), F.col("consequent")[0].alias("consequents"),
                    round_to("confidence", 4).alias("confidence"), round_to("lift", 4).alias("lift"),
                    round_to("support", 6).alias("support"))


# ------------------------------------------------------------------------- E8
def top_rules(rules: DataFrame, k: int | None = None) -> DataFrame:
    """Consequents ranked by confidence per antecedent (tie → consequent)."""
    order = [F.col("confidence").desc(), F.col("consequents")]
    if k:
        from shopsignals.operators.topk import top_k_per_group

        return top_k_per_group(rules, ["antecedents"], order, k)
    return rules.withColumn("rank", F.row_number().over(Window.partitionBy("antecedents").orderBy(*order)))


# ------------------------------------------------------------------------ H16
def bought_together(rules: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """Per catalog SKU, top-k rule consequents; SKUs without any rule
    fall back to their category's top products by reviews (self excluded).

    Output (sku_id, rank, rec_sku, source ∈ {rules, category}).
    """
    from shopsignals.operators.recommend import category_recs

    r = top_rules(rules, k).select(F.col("antecedents").alias("sku_key"),
                                   F.col("consequents").alias("rec_key"), "rank")
    skus = catalog.select("sku_id", F.col("sku_id").cast("string").alias("sku_key"))
    by_rule = skus.join(r, "sku_key", "inner").select(
        "sku_id", "rank", F.col("rec_key").alias("rec_sku"), F.lit("rules").alias("source"))
    no_rule = skus.join(r.select("sku_key").distinct(), "sku_key", "left_anti").select("sku_id")
    fb = category_recs(catalog, k).join(no_rule, "sku_id", "left_semi").select(
        "sku_id", "rank", F.col("rec_sku").cast("string").alias("rec_sku"), F.lit("category").alias("source"))
    return by_rule.unionByName(fb)
