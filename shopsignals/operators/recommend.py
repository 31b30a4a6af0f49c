"""Recommendation operators.

No operator here pairs every product with every other product of its group.
Each ranks a group once, keeps the few entries that can reach a top-k answer
(with a bound proven in the docstring), and joins those to the products on the
group key. Whole-table lists of bounded length (the global top few) are
scalar subqueries holding an array, so they need no join at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.operators.topk import top_k_per_group
from shopsignals.session import materialize, materialize_small

_CARD_COLS = ["sku_id", "category", "subcategory", "review_count", "avg_rating", "inventory_count"]


def _rank(df: DataFrame, part: list, order: list, name: str = "_r") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order) if part else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w))


def _top_array(df: DataFrame, order: list, n: int, fields: list[str]) -> Column:
    """Scalar subquery: the first ``n`` rows of ``df`` in ``order`` as an
    array of structs, sorted. Bounded by ``n``; computed once."""
    top = df.orderBy(*order).limit(n).select(F.struct(*[F.col(f) for f in fields]).alias("s"))
    return top.select(F.array_sort(F.collect_list("s")).alias("a")).scalar()


# ------------------------------------------------------------------------- H6
def category_recs(catalog: DataFrame, k: int = 5) -> DataFrame:
    """H6: for every SKU, its category's top k by reviews, itself removed
    (top k+1 ranked once per category, then joined on category)."""
    order = [F.col("review_count").desc(), F.col("sku_id")]
    top = top_k_per_group(catalog.select("sku_id", "category", "review_count"), ["category"], order, k + 1, "_r")
    top = top.select(
        "category", F.col("sku_id").alias("rec_sku"), F.col("_r").alias("_cr"))
    j = catalog.select("sku_id", "category").join(top, "category").where(F.col("rec_sku") != F.col("sku_id"))
    j = _rank(j, ["sku_id"], ["_cr"], "rank").where(F.col("rank") <= k)
    return j.select("sku_id", "rank", "rec_sku")


# ------------------------------------------------------------------------- H8
def trending_recs(catalog: DataFrame, k: int = 4, pool: int = 6) -> DataFrame:
    """H8: global trending top ``pool`` (reviews × rating), current SKU removed, first k."""
    d = catalog.withColumn("_neg", -(F.col("review_count") * F.col("avg_rating")))
    arr = _top_array(d, [F.col("_neg"), F.col("sku_id")], pool, ["_neg", "sku_id"])
    x = catalog.select("sku_id", F.posexplode(arr).alias("pos", "s"))
    x = x.where(F.col("s.sku_id") != F.col("sku_id"))
    x = _rank(x, ["sku_id"], ["pos"], "rank").where(F.col("rank") <= k)
    return x.select("sku_id", "rank", F.col("s.sku_id").alias("rec_sku"))


# ------------------------------------------------------------------------- H4
def similar_products(catalog: DataFrame, k: int = 5) -> DataFrame:
    """H4: cosine similarity of one-hot (category, subcategory) vectors.

    Each row has exactly two ones, so cosine ∈ {1, 0.5, 0}: 1 for the same
    (category, subcategory), 0.5 when exactly one matches, 0 otherwise. Ties
    go to lower sku_id; the SKU itself is excluded (ruling Q1).

    Bounded candidates per SKU s = (c, u):
    * score 1: first k+1 of group (c, u);
    * score .5, same c: first 2k of M_c, where M_c keeps the first k items of
      every (c, sub) group. At most k entries of M_c have sub u, so the first
      k with sub ≠ u lie in its first 2k; symmetric for same u, other c;
    * score 0: every answer item t is in the first 2k of M_cat(t) and of
      M'_sub(t); in that set at most 2k rows precede t with cat c and at most
      2k with sub u, so the first 5k rows (global sku order) suffice.

    All but the SKU's own removal is the same for all SKUs of a group (c, u), so
    each group is ranked once, k+1 entries, and handed to its SKUs as one list.
    Only SKUs listed several times and rows without an id are ranked by themselves.
    """
    cat = materialize(catalog.select("sku_id", "category", "subcategory"))  # read once, ranked several times
    by_id = [F.col("sku_id")]
    g1 = top_k_per_group(cat, ["category", "subcategory"], by_id, k + 1, "_r")
    r_cs = top_k_per_group(cat, ["category", "subcategory"], by_id, k, "_rcs").drop("_rcs")
    m_c = top_k_per_group(r_cs, ["category"], by_id, 2 * k, "_rc")
    m_u = top_k_per_group(r_cs, ["subcategory"], by_id, 2 * k, "_ru")
    # score-0 padding from a bounded global list (scalar subquery)
    g = m_c.select("sku_id", "category", "subcategory").join(m_u.select("sku_id"), "sku_id")
    pad = _top_array(g, by_id, 5 * k, ["sku_id", "category", "subcategory"])

    def ranked(who: DataFrame, by: list[str], other: Column, n: int) -> DataFrame:
        """The first ``n`` candidates (rec_sku, score, rank) of each row of ``who``;
        ``other`` tells a candidate of scores 1 and 0 from the row itself."""
        s1 = (who.join(g1.select("category", "subcategory", F.col("sku_id").alias("rec_sku")), ["category", "subcategory"])
              .where(other).select(*by, "rec_sku", F.lit(1.0).alias("score")))
        s2a = (who.join(m_c.select("category", F.col("subcategory").alias("_sub"), F.col("sku_id").alias("rec_sku")),
                        "category").where(F.col("_sub") != F.col("subcategory"))
               .select(*by, "rec_sku", F.lit(0.5).alias("score")))
        s2b = (who.join(m_u.select("subcategory", F.col("category").alias("_cat"), F.col("sku_id").alias("rec_sku")),
                        "subcategory").where(F.col("_cat") != F.col("category"))
               .select(*by, "rec_sku", F.lit(0.5).alias("score")))
        s3 = who.withColumn("p", F.explode(pad)).withColumn("rec_sku", F.col("p.sku_id"))
        s3 = s3.where((F.col("p.category") != F.col("category")) & (F.col("p.subcategory") != F.col("subcategory")) & other)
        s3 = _rank(s3, by, ["rec_sku"], "_pp").where(F.col("_pp") <= k).select(*by, "rec_sku", F.lit(0.0).alias("score"))
        allc = s1.unionByName(s2a).unionByName(s2b).unionByName(s3)
        allc = allc.groupBy(*by, "rec_sku").agg(F.max("score").alias("score"))
        return _rank(allc, by, [F.col("score").desc(), F.col("rec_sku")], "rank").where(F.col("rank") <= n)

    often = materialize_small(cat.groupBy("sku_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sku_id"))
    group = ["category", "subcategory"]
    lists = ranked(g1.select(*group).distinct(), group, F.col("rec_sku").isNotNull(), k + 1)
    lists = materialize_small(lists.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "rec_sku", "score"))).alias("_l")))
    once = cat.where(F.col("sku_id").isNotNull()).join(often, "sku_id", "left_anti").join(lists, group)
    mine = F.slice(F.filter("_l", lambda x: ~x["rec_sku"].eqNullSafe(F.col("sku_id"))), 1, k)
    out = once.select("sku_id", F.posexplode(mine).alias("_at", "_x")).select(
        "sku_id", (F.col("_at") + 1).alias("rank"), "_x.rec_sku", "_x.score")
    more = materialize(cat.join(often, "sku_id", "left_semi").unionByName(cat.where(F.col("sku_id").isNull())))
    if more.isEmpty():
        return out
    return out.unionByName(ranked(more, ["sku_id"], F.col("rec_sku") != F.col("sku_id"), k).select("sku_id", "rank", "rec_sku", "score"))


# ------------------------------------------------------------------------- H5
def _engine_level(cat: DataFrame, key: str | None, k: int, level: int) -> DataFrame:
    """Candidates of one fallback level: group by ``key`` (None = whole table).

    score = .6·rating + .3·ln(1+reviews) + .1·inv/(M+1), M = max inventory of
    the candidates (the group without the SKU itself). M is the group max M1
    unless the SKU alone holds it, then the runner-up M2, so the group is
    ranked under both and each SKU reads the list of its own M (k+1 each).
    """
    part = [key] if key else []
    base = 0.6 * F.col("avg_rating") + 0.3 * F.log1p(F.col("review_count"))
    if key:
        inv_rank = top_k_per_group(cat, part, [F.col("inventory_count").desc(), F.col("sku_id")], 2, "_ir")
        stats = inv_rank.groupBy(key).agg(
            F.max(F.when(F.col("_ir") == 1, F.col("inventory_count"))).alias("_m1"),
            F.max(F.when(F.col("_ir") == 2, F.col("inventory_count"))).alias("_m2"),
            F.count(F.lit(1)).alias("_gn"))
        g = cat.join(stats, key)
    else:
        top2 = _top_array(cat.withColumn("_ni", -F.col("inventory_count")), [F.col("_ni"), F.col("sku_id")],
                          2, ["_ni", "sku_id"])
        n = cat.select(F.count(F.lit(1))).scalar()
        g = cat.withColumn("_m1", -top2[0]["_ni"]).withColumn(
            "_m2", F.when(F.size(top2) > 1, -top2[1]["_ni"])).withColumn("_gn", n)
    me = g.where(F.col("_lvl") == level).withColumn("_which", F.when((F.col("inventory_count") == F.col("_m1"))
                                       & (F.coalesce(F.col("_m2"), F.lit(-1)) < F.col("_m1")), "m2")
                      .otherwise("m1"))
    me = me.select("sku_id", *part, "_which", "_gn")
    if key:
        lists = []
        for tag, mcol in (("m1", "_m1"), ("m2", "_m2")):
            sc = g.withColumn("_score", base + F.try_divide(0.1 * F.col("inventory_count"), F.col(mcol) + 1))
            rk = top_k_per_group(sc, part, [F.col("_score").desc(), F.col("sku_id")], k + 1, "_pr")
            lists.append(rk.select(*part, F.lit(tag).alias("_which"), F.col("sku_id").alias("rec_sku"),
                                   F.col("_score").alias("score"), "_pr"))
        j = me.join(lists[0].unionByName(lists[1]), part + ["_which"])
    else:
        # whole-table level: the two bounded top-(k+1) lists are scalar arrays
        arrs = {}
        for tag, mcol in (("m1", "_m1"), ("m2", "_m2")):
            sc = g.withColumn("_score", base + F.try_divide(0.1 * F.col("inventory_count"), F.col(mcol) + 1)) \
                  .withColumn("_ns", -F.col("_score"))
            arrs[tag] = _top_array(sc, [F.col("_ns"), F.col("sku_id")], k + 1, ["_ns", "sku_id", "_score"])
        arr = F.when(F.col("_which") == "m1", arrs["m1"]).otherwise(arrs["m2"])
        j = me.select("sku_id", "_which", "_gn", F.posexplode(arr).alias("_pr", "c")).select(
            "sku_id", "_which", "_gn", (F.col("_pr") + 1).alias("_pr"),
            F.col("c.sku_id").alias("rec_sku"), F.col("c._score").alias("score"))
    j = j.where(F.col("rec_sku") != F.col("sku_id"))
    return j.select("sku_id", "rec_sku", "score", "_pr", F.lit(level).alias("level"),
                    (F.col("_gn") > 1).alias("_has"))


def engine_recs(catalog: DataFrame, k: int = 5) -> DataFrame:
    """H5: same-subcategory candidates, else same category, else all; top k by score.

    Each SKU's level follows from the sizes of its groups, so it joins one list.
    """
    cat = catalog.select(*_CARD_COLS).withColumn("avg_rating", F.coalesce("avg_rating", F.lit(0.0))) \
        .withColumn("review_count", F.coalesce("review_count", F.lit(0))) \
        .withColumn("inventory_count", F.coalesce("inventory_count", F.lit(0)))
    cat = materialize(cat)  # the slim catalog, read once and written: every level ranks it again
    for c in ("subcategory", "category"):
        size = cat.groupBy(F.col(c).alias("_of")).agg(F.count(F.lit(1)).alias(f"_{c}"))
        cat = cat.join(size, F.col(c) == F.col("_of"), "left").drop("_of")
    level = F.when(F.col("_subcategory") > 1, 1).when(F.col("_category") > 1, 2).otherwise(3)
    cat = materialize(cat.withColumn("_lvl", level).drop("_subcategory", "_category"))
    x = (_engine_level(cat, "subcategory", k, 1)
         .unionByName(_engine_level(cat, "category", k, 2))
         .unionByName(_engine_level(cat, None, k, 3))).where("_has")
    x = _rank(x, ["sku_id"], [F.col("score").desc(), F.col("rec_sku")], "rank").where(F.col("rank") <= k)
    return x.select("sku_id", "rank", "rec_sku", "score", "level")


# ------------------------------------------------------------------------- H7
def session_recs(events: DataFrame, catalog: DataFrame, per_category: int = 2, k: int = 4) -> DataFrame:
    """H7: for each user, the categories of products they viewed other than
    the category of their latest product, top ``per_category`` each by
    reviews, at most k in category-name order (the reference's set order is
    arbitrary)."""
    cat = catalog.select("sku_id", "category", "review_count")
    ev = events.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    cur = ev.groupBy("user_id").agg(F.max_by("product_id", F.struct("timestamp", "event_id")).alias("cur_sku"))
    cur = cur.join(cat.select(F.col("sku_id").alias("cur_sku"), F.col("category").alias("cur_cat")), "cur_sku")
    seen = (ev.select("user_id", F.col("product_id").alias("sku_id")).distinct()
            .join(cat.select("sku_id", "category"), "sku_id").select("user_id", "category").distinct())
    seen = seen.join(cur, "user_id").where(F.col("category") != F.col("cur_cat"))
    top = top_k_per_group(cat, ["category"], [F.col("review_count").desc(), F.col("sku_id")], per_category, "_r")
    j = seen.join(top.select("category", F.col("sku_id").alias("rec_sku"), "_r"), "category")
    j = _rank(j, ["user_id"], ["category", "_r"], "rank").where(F.col("rank") <= k)
    return j.select("user_id", "cur_sku", "rank", "rec_sku", "category")


# ------------------------------------------------------------------------ H10
def recommend_all(catalog: DataFrame, active: DataFrame, events: DataFrame, k: int = 5) -> DataFrame:
    """Every strategy, labelled and unioned.

    (sku_id, user_id, strategy, rank, rec_sku, explanation). Answers are given for
    active SKUs only; the engine strategy ranks the whole ``catalog``, the others
    the ``active`` one. The session strategy answers a user's request for their
    latest product, so its rows carry the user; the others hold for any user.
    """
    nobody = F.lit(None).cast(dict(events.dtypes)["user_id"]).alias("user_id")
    eng = engine_recs(catalog, k).select("sku_id", nobody, F.lit("category_based").alias("strategy"), "rank", "rec_sku")
    cat = category_recs(active, k).select("sku_id", nobody, F.lit("frequently_bought").alias("strategy"), "rank", "rec_sku")
    tr = trending_recs(active, 4).select("sku_id", nobody, F.lit("trending").alias("strategy"), "rank", "rec_sku")
    ses = session_recs(events, active).select(F.col("cur_sku").alias("sku_id"), "user_id",
                                              F.lit("session_based").alias("strategy"), "rank", "rec_sku")
    out = eng.unionByName(cat).unionByName(tr).unionByName(ses)
    info = active.select("sku_id", "category", "subcategory")
    out = out.join(info, "sku_id")
    expl = (F.when(F.col("strategy") == "category_based",
                   F.concat(F.lit("Similar products in "), F.col("category"), F.lit(" > "), F.col("subcategory"),
                            F.lit(" (ML model)")))
             .when(F.col("strategy") == "frequently_bought", F.concat(F.lit("Top rated products in "), F.col("category")))
             .when(F.col("strategy") == "session_based", F.lit("Based on your browsing history"))
             .otherwise(F.lit("Most popular products right now (by rating & reviews)")))
    return out.select("sku_id", "user_id", "strategy", "rank", "rec_sku", expl.alias("explanation"))


# ------------------------------------------------------------------------ H14
def fit_next_item(seqs: DataFrame) -> DataFrame:
    """First-order transition model from session sequences (E6 long form).

    (item, next_item, n, prob) with prob = n / transitions out of item.
    """
    w = Window.partitionBy("session_id").orderBy("pos")
    t = (seqs.withColumn("next_item", F.lead("item_idx").over(w))
         .where(F.col("next_item").isNotNull())
         .groupBy(F.col("item_idx").alias("item"), "next_item").agg(F.count(F.lit(1)).alias("n")))
    out_n = t.groupBy("item").agg(F.sum("n").alias("_out"))
    return t.join(out_n, "item").withColumn("prob", F.col("n") / F.col("_out")).drop("_out")


def item_popularity(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy(F.col("item_idx").alias("item")).agg(F.count(F.lit(1)).alias("pop"))


def recommend_next(model: DataFrame, seqs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top-k next items for each query (qid, last_item): transitions by
    probability, then popularity back-off for the remaining slots; the last
    item itself is never recommended.

    Back-off needs at most k + 1 popular items plus the item's own
    transitions to be removed, so the global top (k + 1) list is enough once
    the transition candidates (≤ k) are excluded: a bounded scalar array.
    """
    trans = top_k_per_group(model.where(F.col("next_item") != F.col("item")), ["item"],
                            [F.col("prob").desc(), F.col("next_item")], k, "_t")
    q = queries.select("qid", F.col("last_item").alias("item"))
    a = q.join(trans.select("item", F.col("next_item").alias("rec"), "_t"), "item")
    a = a.select("qid", "item", "rec", F.lit(0).alias("_src"), F.col("_t").cast("double").alias("_o"))
    pop = item_popularity(seqs).withColumn("_np", -F.col("pop"))
    top = _top_array(pop, [F.col("_np"), F.col("item")], 2 * k + 1, ["_np", "item"])
    b = q.select("qid", "item", F.posexplode(top).alias("_o", "p")).select(
        "qid", "item", F.col("p.item").alias("rec"), F.lit(1).alias("_src"), F.col("_o").cast("double"))
    b = b.where(F.col("rec") != F.col("item")).join(a.select("qid", "rec"), ["qid", "rec"], "left_anti")
    x = _rank(a.unionByName(b), ["qid"], ["_src", "_o"], "rank").where(F.col("rank") <= k)
    return x.select("qid", "rank", "rec")


# ------------------------------------------------------------------------ H15
def ranking_metrics(recs: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Hit rate@k and MRR@k; queries without a hit count as 0."""
    hit = recs.where(F.col("rank") <= k).join(truth, ["qid"]).where(F.col("rec") == F.col("target")) \
        .groupBy("qid").agg(F.min("rank").alias("hit_rank"))
    t = truth.select("qid").join(hit, "qid", "left")
    return t.agg(F.avg(F.when(F.col("hit_rank").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"),
                 F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"),
                 F.count(F.lit(1)).alias("n_samples"))
