"""Registered queries: baskets, association rules, recommendations, search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shopsignals.operators import baskets as bk
from shopsignals.operators import catalog as ct
from shopsignals.operators import recommend as rc
from shopsignals.operators import search as se
from shopsignals.operators import sessions as ss
from shopsignals.plans.q_sessions import E6_SQL
from shopsignals.plans.registry import query

CAT = ("fx_catalog",)
ACTIVE = ("fx_catalog_active",)


def _active(fx):
    """The service-layer catalog: active rows with display defaults (B1)."""
    return ct.clean_catalog(fx("fx_catalog"))


def _on_active(sql: str) -> str:
    """An oracle over the catalog, read from the active-catalog view instead."""
    return sql.replace("fx_catalog", "fx_catalog_active")


_RULES_OUT = "antecedents:s consequents:s confidence:d lift:d support:d"


def _r(x, d):
    k = f"{10 ** d}.0"
    return f"(round(({x}) * {k}) / {k})"


def rules_sql(basket_sql: str, min_count: int, min_support: float, min_conf: float) -> str:
    """Oracle: the reference's counting recipe written as plain SQL."""
    return f"""
WITH ev AS ({basket_sql}),
 fi AS (SELECT item FROM ev GROUP BY item HAVING count(*) >= {min_count}),
 fb AS (SELECT DISTINCT basket, item FROM ev WHERE item IN (SELECT item FROM fi)),
 kb AS (SELECT basket FROM fb GROUP BY basket HAVING count(*) >= 2),
 b AS (SELECT * FROM fb WHERE basket IN (SELECT basket FROM kb)),
 n AS (SELECT count(DISTINCT basket) AS n FROM b),
 s AS (SELECT item, count(*) AS c FROM b GROUP BY item),
 p AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item
  GROUP BY x.item, y.item),
 r AS (SELECT p.a, p.b, p.c / n.n AS support, sa.c / n.n AS supp_a, sb.c / n.n AS supp_b
  FROM p, n, s sa, s sb WHERE sa.item = p.a AND sb.item = p.b AND p.c / n.n >= {min_support}),
 d AS (SELECT a AS ant, b AS con, support, support / supp_a AS confidence, supp_b AS supp_con FROM r
  UNION ALL SELECT b, a, support, support / supp_b, supp_a FROM r)
SELECT CAST(ant AS VARCHAR) AS antecedents, CAST(con AS VARCHAR) AS consequents,
 {_r('confidence', 4)} AS confidence, {_r('confidence / supp_con', 4)} AS lift, {_r('support', 6)} AS support
FROM d WHERE confidence >= {min_conf}"""


SESSION_BASKETS = ("SELECT session_id AS basket, sku_id AS item FROM fx_clickstream "
                   "WHERE event_type IN ('purchase', 'add_to_cart') AND session_id IS NOT NULL AND sku_id IS NOT NULL")
USER_BASKETS = "SELECT user_id AS basket, sku_id AS item FROM fx_clickstream WHERE user_id IS NOT NULL AND sku_id IS NOT NULL"
BRAND_BASKETS = ("SELECT o.order_id AS basket, c.brand AS item FROM fx_orders o JOIN fx_catalog c "
                 "ON o.product_id = c.sku_id WHERE c.brand IS NOT NULL")
PART_BASKETS = "SELECT order_id AS basket, product_id AS item FROM fx_orders"


@query("d21_filter_baskets", "basket:s item:i basket_size:i", views=("fx_clickstream",), oracle=f"""
WITH ev AS ({SESSION_BASKETS}), fi AS (SELECT item FROM ev GROUP BY item HAVING count(*) >= 5),
 fb AS (SELECT DISTINCT basket, item FROM ev WHERE item IN (SELECT item FROM fi)),
 kb AS (SELECT basket, count(*) AS basket_size FROM fb GROUP BY basket HAVING count(*) >= 2)
SELECT fb.basket, fb.item, kb.basket_size FROM fb JOIN kb USING (basket)""")
def d21(fx):
    """D20 + D21: session baskets of purchase/cart events, rare items dropped."""
    b = bk.baskets(fx("fx_clickstream"), "session_id", "sku_id", ["purchase", "add_to_cart"])
    return bk.filter_baskets(b, 5)


@query("d22_item_pairs", "item_a:i item_b:i n_ab:i", views=("fx_orders",), oracle="""
WITH b AS (SELECT DISTINCT order_id AS basket, product_id AS item FROM fx_orders)
SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab FROM b x JOIN b y
 ON x.basket = y.basket AND x.item < y.item GROUP BY x.item, y.item""")
def d22(fx):
    """C10 + D22: pair counts over order × part baskets (chunked self-join)."""
    b = bk.filter_baskets(bk.baskets(fx("fx_orders"), "order_id", "product_id"), 1, 1)
    return bk.item_pairs(b, chunk_items=2)


@query("h1_rules_session", _RULES_OUT, views=("fx_clickstream",),
       oracle=rules_sql(SESSION_BASKETS, 5, 0.0003, 0.02))
def h1s(fx):
    """H1: rules from session baskets (purchase / add_to_cart)."""
    return bk.rules_from_events(fx("fx_clickstream"), "session_id", "sku_id", ["purchase", "add_to_cart"])


@query("h1_rules_order_brand", _RULES_OUT, views=("fx_orders", "fx_catalog"),
       oracle=rules_sql(BRAND_BASKETS, 5, 0.0003, 0.02))
def h1b(fx):
    """H1: rules over order × brand baskets."""
    o = fx("fx_orders").join(fx("fx_catalog").select(F.col("sku_id").alias("product_id"), "brand"), "product_id")
    return bk.rules_from_events(o, "order_id", "brand")


@query("h1_rules_order_parts", _RULES_OUT, views=("fx_orders",), oracle=rules_sql(PART_BASKETS, 5, 0.0, 0.02))
def h1p(fx):
    """H1 with min_support 0 over order × part baskets (every pair counts)."""
    return bk.rules_from_events(fx("fx_orders"), "order_id", "product_id", min_support=0.0)


@query("h3_rules_user", _RULES_OUT, views=("fx_clickstream",), oracle=rules_sql(USER_BASKETS, 5, 0.001, 0.05))
def h3(fx):
    """H3: user-basket rules (any event), support .001, confidence .05."""
    return bk.rules_from_events(fx("fx_clickstream"), "user_id", "sku_id", min_support=0.001, min_confidence=0.05)


@query("e8_top_rules", _RULES_OUT + " rank:i", views=("fx_clickstream",), oracle=f"""
SELECT *, row_number() OVER (PARTITION BY antecedents ORDER BY confidence DESC, consequents) AS rank
FROM ({rules_sql(USER_BASKETS, 5, 0.001, 0.05)})""")
def e8(fx):
    """Rules ranked per antecedent by confidence."""
    r = bk.rules_from_events(fx("fx_clickstream"), "user_id", "sku_id", min_support=0.001, min_confidence=0.05)
    return bk.top_rules(r)


_CATREC_SQL = """
WITH t AS (SELECT category, sku_id AS rec_sku, row_number() OVER (PARTITION BY category
  ORDER BY review_count DESC, sku_id) AS cr FROM fx_catalog),
 j AS (SELECT c.sku_id, t.rec_sku, t.cr FROM fx_catalog c JOIN t ON c.category = t.category
  WHERE t.cr <= 6 AND t.rec_sku <> c.sku_id)
SELECT sku_id, rank, rec_sku FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY cr) AS rank FROM j)
WHERE rank <= 5"""


@query("h16_bought_together", "sku_id:i rank:i rec_sku:s source:s", views=("fx_clickstream",) + ACTIVE,
       oracle=_on_active(f"""
WITH r AS (SELECT antecedents, consequents, row_number() OVER (PARTITION BY antecedents
  ORDER BY confidence DESC, consequents) AS rank FROM ({rules_sql(USER_BASKETS, 5, 0.001, 0.05)})),
 a AS (SELECT c.sku_id, r.rank, r.consequents AS rec_sku, 'rules' AS source FROM fx_catalog c
  JOIN r ON CAST(c.sku_id AS VARCHAR) = r.antecedents WHERE r.rank <= 5),
 f AS (SELECT q.sku_id, q.rank, CAST(q.rec_sku AS VARCHAR) AS rec_sku, 'category' AS source FROM ({_CATREC_SQL}) q
  WHERE CAST(q.sku_id AS VARCHAR) NOT IN (SELECT antecedents FROM r))
SELECT * FROM a UNION ALL SELECT * FROM f"""))
def h16(fx):
    """Rule lookup with category fallback for every catalog SKU."""
    r = bk.rules_from_events(fx("fx_clickstream"), "user_id", "sku_id", min_support=0.001, min_confidence=0.05)
    return bk.bought_together(r, _active(fx), 5)


@query("h4_similar_products", "sku_id:i rank:i rec_sku:i score:d", views=ACTIVE, oracle="""
WITH p AS (SELECT a.sku_id, b.sku_id AS rec_sku,
  ((CASE WHEN a.category = b.category THEN 1 ELSE 0 END) + (CASE WHEN a.subcategory = b.subcategory THEN 1 ELSE 0 END)) / 2.0 AS score
  FROM fx_catalog_active a JOIN fx_catalog_active b ON a.sku_id <> b.sku_id)
SELECT * FROM (SELECT sku_id, row_number() OVER (PARTITION BY sku_id ORDER BY score DESC, rec_sku) AS rank,
 rec_sku, score FROM p) WHERE rank <= 5""")
def h4(fx):
    """H4: cosine-similar products (brute force in the oracle, bounded candidates in Spark)."""
    return rc.similar_products(_active(fx), 5)


_ENGINE_SQL = """
WITH c AS (SELECT sku_id, category, subcategory, coalesce(avg_rating, 0) AS r, coalesce(review_count, 0) AS n,
  coalesce(inventory_count, 0) AS inv FROM fx_catalog),
 lv AS (SELECT s.sku_id, CASE WHEN EXISTS (SELECT 1 FROM c o WHERE o.subcategory = s.subcategory AND o.sku_id <> s.sku_id) THEN 1
  WHEN EXISTS (SELECT 1 FROM c o WHERE o.category = s.category AND o.sku_id <> s.sku_id) THEN 2 ELSE 3 END AS level,
  s.category, s.subcategory FROM c s),
 cand AS (SELECT lv.sku_id, lv.level, o.sku_id AS rec_sku, o.r, o.n, o.inv FROM lv JOIN c o ON o.sku_id <> lv.sku_id
  AND ((lv.level = 1 AND o.subcategory = lv.subcategory) OR (lv.level = 2 AND o.category = lv.category) OR lv.level = 3)),
 m AS (SELECT *, max(inv) OVER (PARTITION BY sku_id) AS mx FROM cand),
 sc AS (SELECT sku_id, level, rec_sku, 0.6 * r + 0.3 * ln(1 + n) + 0.1 * inv / (mx + 1) AS score FROM m)
SELECT * FROM (SELECT sku_id, row_number() OVER (PARTITION BY sku_id ORDER BY score DESC, rec_sku) AS rank,
 rec_sku, score, level FROM sc) WHERE rank <= 5"""


@query("h5_engine_recs", "sku_id:i rank:i rec_sku:i score:d level:i", views=CAT, oracle=_ENGINE_SQL)
def h5(fx):
    """H5: three-level fallback recommendations with the score formula."""
    return rc.engine_recs(fx("fx_catalog"), 5)


@query("h6_category_recs", "sku_id:i rank:i rec_sku:i", views=ACTIVE, oracle=_on_active(_CATREC_SQL))
def h6(fx):
    """H6: same-category top 5, current removed."""
    return rc.category_recs(_active(fx), 5)


_TREND_SQL = """
WITH t AS (SELECT sku_id AS rec_sku, row_number() OVER (ORDER BY review_count * avg_rating DESC, sku_id) AS tr
  FROM fx_catalog QUALIFY tr <= 6)
SELECT sku_id, rank, rec_sku FROM (SELECT c.sku_id, t.rec_sku, row_number() OVER (PARTITION BY c.sku_id ORDER BY t.tr) AS rank
 FROM fx_catalog c JOIN t ON t.rec_sku <> c.sku_id) WHERE rank <= 4"""


@query("h8_trending_recs", "sku_id:i rank:i rec_sku:i", views=ACTIVE, oracle=_on_active(_TREND_SQL))
def h8(fx):
    """H8: trending top 6 with the current product removed, first 4."""
    return rc.trending_recs(_active(fx), 4, 6)


_SESSION_SQL = """
WITH e AS (SELECT * FROM fx_live_clicks WHERE user_id IS NOT NULL AND product_id IS NOT NULL),
 cur AS (SELECT user_id, arg_max(product_id, (timestamp, event_id)) AS cur_sku FROM e GROUP BY user_id),
 cc AS (SELECT cur.*, c.category AS cur_cat FROM cur JOIN fx_catalog c ON cur.cur_sku = c.sku_id),
 seen AS (SELECT DISTINCT e.user_id, c.category FROM e JOIN fx_catalog c ON e.product_id = c.sku_id),
 s2 AS (SELECT seen.user_id, seen.category, cc.cur_sku FROM seen JOIN cc USING (user_id) WHERE seen.category <> cc.cur_cat),
 t AS (SELECT category, sku_id AS rec_sku, row_number() OVER (PARTITION BY category ORDER BY review_count DESC, sku_id) AS r
  FROM fx_catalog QUALIFY r <= 2)
SELECT * FROM (SELECT s2.user_id, s2.cur_sku, row_number() OVER (PARTITION BY s2.user_id ORDER BY s2.category, t.r) AS rank,
 t.rec_sku, s2.category FROM s2 JOIN t USING (category)) WHERE rank <= 4"""


@query("h7_session_recs", "user_id:i cur_sku:i rank:i rec_sku:i category:s", views=("fx_live_clicks",) + ACTIVE,
       oracle=_on_active(_SESSION_SQL))
def h7(fx):
    """H7: session-based recommendations per user, from the active catalog."""
    return rc.session_recs(fx("fx_live_clicks"), _active(fx))


@query("h10_recommend_all", "sku_id:i user_id:i strategy:s rank:i rec_sku:i explanation:s",
       views=CAT + ACTIVE + ("fx_live_clicks",), oracle=f"""
SELECT e.sku_id, NULL AS user_id, 'category_based' AS strategy, e.rank, e.rec_sku,
 'Similar products in ' || c.category || ' > ' || c.subcategory || ' (ML model)' AS explanation
FROM ({_ENGINE_SQL}) e JOIN fx_catalog_active c ON e.sku_id = c.sku_id
UNION ALL SELECT q.sku_id, NULL, 'frequently_bought', q.rank, q.rec_sku, 'Top rated products in ' || c.category
FROM ({_on_active(_CATREC_SQL)}) q JOIN fx_catalog_active c ON q.sku_id = c.sku_id
UNION ALL SELECT q.sku_id, NULL, 'trending', q.rank, q.rec_sku, 'Most popular products right now (by rating & reviews)'
FROM ({_on_active(_TREND_SQL)}) q
UNION ALL SELECT q.cur_sku, q.user_id, 'session_based', q.rank, q.rec_sku, 'Based on your browsing history'
FROM ({_on_active(_SESSION_SQL)}) q""")
def h10(fx):
    """H10 + G2: all strategies, labelled; answers for active SKUs only."""
    return rc.recommend_all(fx("fx_catalog"), _active(fx), fx("fx_live_clicks"))


_TOK_SQL = r"""
WITH d AS (SELECT sku_id, lower(concat_ws(' ', coalesce(product_name, ''), coalesce(brand, ''), coalesce(category, ''),
  coalesce(subcategory, ''))) AS txt FROM fx_catalog),
 t AS (SELECT sku_id, unnest(regexp_extract_all(txt, '\b\w\w+\b')) AS term FROM d),
 tf AS (SELECT sku_id, term, count(*) AS tf FROM t GROUP BY sku_id, term),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 w AS (SELECT tf.sku_id, tf.term, df.df, tf.tf * (ln((1 + (SELECT count(*) FROM fx_catalog)) / (1 + df.df)) + 1) AS raw
  FROM tf JOIN df USING (term))
SELECT sku_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY sku_id)) AS weight, df FROM w"""


@query("h11_tfidf_index", "sku_id:i term:s weight:d df:i", views=ACTIVE, oracle=_on_active(_TOK_SQL))
def h11(fx):
    """TF-IDF index over name, brand, category and subcategory."""
    return se.tfidf_index(_active(fx))


@query("h12_brand_search", "qid:s detected_sku:i brand:s best_score:d rank:i rec_sku:i", views=ACTIVE, oracle=rf"""
WITH idx AS ({_on_active(_TOK_SQL)}),
 q AS (SELECT DISTINCT p_name AS qid, lower(p_name) AS query FROM part),
 qt AS (SELECT qid, unnest(regexp_extract_all(query, '\b\w\w+\b')) AS term FROM q),
 qtf AS (SELECT qid, term, count(*) AS tf FROM qt GROUP BY qid, term),
 v AS (SELECT DISTINCT term, df FROM idx),
 qw AS (SELECT qtf.qid, qtf.term, qtf.tf * (ln((1 + (SELECT count(*) FROM fx_catalog_active)) / (1 + v.df)) + 1) AS raw
  FROM qtf JOIN v USING (term)),
 qv AS (SELECT qid, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY qid)) AS qweight FROM qw),
 sc AS (SELECT qv.qid, idx.sku_id, sum(qv.qweight * idx.weight) AS score FROM qv JOIN idx USING (term) GROUP BY qv.qid, idx.sku_id),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, sku_id) AS rn FROM sc) WHERE rn = 1
  AND score >= 0.05),
 bb AS (SELECT b.qid, b.sku_id AS detected_sku, b.score AS best_score, c.brand, lower(c.brand) AS lb FROM b
  JOIN fx_catalog_active c ON b.sku_id = c.sku_id),
 t AS (SELECT sku_id, lower(brand) AS lb, row_number() OVER (PARTITION BY lower(brand) ORDER BY review_count DESC, sku_id) AS rank
  FROM fx_catalog_active)
SELECT bb.qid, bb.detected_sku, bb.brand, bb.best_score, t.rank, t.sku_id AS rec_sku FROM bb JOIN t USING (lb)
WHERE t.rank <= 10""")
def h12(fx):
    """Brand search for every distinct part name used as a query."""
    q = fx("part").select(F.col("p_name").alias("qid"), F.col("p_name").alias("query")).distinct()
    return se.brand_search(_active(fx), q, 10)


# -------------------------------------------------------------- H14 / H15
def _samples(fx):
    from shopsignals.session import materialize

    # the sequences feed the model, the popularity list and the samples
    seqs = materialize(ss.session_sequences(fx("fx_clickstream"), fx("fx_catalog")))
    return seqs, _last_items(seqs)


def _last_items(seqs):
    """The item before and the item itself at each position: what the padded samples end in."""
    w = Window.partitionBy("session_id").orderBy("pos")
    return (seqs.withColumn("last_item", F.lag("item_idx").over(w)).where(F.col("pos") >= 3)
            .select(F.concat_ws(":", "session_id", F.col("pos").cast("string")).alias("qid"), "last_item",
                    F.col("item_idx").alias("target")))


def _next_sql(train: str = "true", scored: str = "true") -> str:
    return _NEXT_SQL.replace("/*train*/ true", train).replace("/*scored*/ true", scored)


_NEXT_SQL = f"""
WITH al AS ({E6_SQL}), s AS (SELECT * FROM al WHERE /*train*/ true), sc AS (SELECT * FROM al WHERE /*scored*/ true),
 tr AS (SELECT a.item_idx AS item, b.item_idx AS next_item, count(*) AS n FROM s a JOIN s b
  ON a.session_id = b.session_id AND b.pos = a.pos + 1 GROUP BY 1, 2),
 pr AS (SELECT *, n / sum(n) OVER (PARTITION BY item) AS prob FROM tr),
 tk AS (SELECT * FROM (SELECT item, next_item, row_number() OVER (PARTITION BY item ORDER BY prob DESC, next_item) AS t
  FROM pr WHERE next_item <> item) WHERE t <= 10),
 pop AS (SELECT item_idx AS item, count(*) AS pop FROM s GROUP BY item_idx),
 pl AS (SELECT item, row_number() OVER (ORDER BY pop DESC, item) - 1 AS o FROM pop QUALIFY o < 21),
 q AS (SELECT t.session_id || ':' || CAST(t.pos AS VARCHAR) AS qid, l.item_idx AS last_item, t.item_idx AS target
  FROM sc t JOIN sc l ON t.session_id = l.session_id AND l.pos = t.pos - 1 WHERE t.pos >= 3),
 a AS (SELECT q.qid, tk.next_item AS rec, 0 AS src, tk.t AS o FROM q JOIN tk ON q.last_item = tk.item),
 b AS (SELECT q.qid, pl.item AS rec, 1 AS src, pl.o FROM q, pl WHERE pl.item <> q.last_item
  AND NOT EXISTS (SELECT 1 FROM a WHERE a.qid = q.qid AND a.rec = pl.item)),
 recs AS (SELECT * FROM (SELECT qid, rec, row_number() OVER (PARTITION BY qid ORDER BY src, o) AS rank
  FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE rank <= 10)"""


@query("h14_next_item_recs", "qid:s rank:i rec:i", views=("fx_clickstream", "fx_catalog"),
       oracle=_NEXT_SQL + " SELECT * FROM recs")
def h14(fx):
    """Next-item transition model with popularity back-off, top 10 per sample."""
    seqs, q = _samples(fx)
    return rc.recommend_next(rc.fit_next_item(seqs), seqs, q, 10)


_METRICS_SQL = """, h AS (SELECT r.qid, min(r.rank) AS hr FROM recs r JOIN q ON r.qid = q.qid AND r.rec = q.target
  GROUP BY r.qid)
SELECT avg(CASE WHEN h.hr IS NOT NULL THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(coalesce(1.0 / h.hr, 0.0)) AS mrr,
 count(*) AS n_samples FROM q LEFT JOIN h ON q.qid = h.qid"""
_HELD_OUT = "substr(md5(session_id || ':42'), 1, 8) < '1999999a'"  # a tenth of the sessions


@query("h15_heldout_metrics", "hit_rate:d mrr:d n_samples:i", views=("fx_clickstream", "fx_catalog"),
       oracle=_next_sql(f"NOT ({_HELD_OUT})", _HELD_OUT) + _METRICS_SQL)
def h15_heldout(fx):
    """Hit rate@10 and MRR@10 on a tenth of the sessions, the model fitted on the others."""
    seqs, _ = _samples(fx)
    held = F.expr("substr(md5(cast(concat(session_id, ':42') as binary)), 1, 8) < '1999999a'")
    train, val = seqs.where(~held), seqs.where(held)
    q = _last_items(val)
    recs = rc.recommend_next(rc.fit_next_item(train), train, q, 10)
    return rc.ranking_metrics(recs, q.select("qid", "target"), 10)


@query("h15_ranking_metrics", "hit_rate:d mrr:d n_samples:i", views=("fx_clickstream", "fx_catalog"),
       oracle=_NEXT_SQL + _METRICS_SQL)
def h15(fx):
    """Hit rate@10 and MRR@10 of the next-item model on the samples it was
    fitted on; ``h15_heldout_metrics`` has the figures of unseen sessions."""
    seqs, q = _samples(fx)
    recs = rc.recommend_next(rc.fit_next_item(seqs), seqs, q, 10)
    return rc.ranking_metrics(recs, q.select("qid", "target"), 10)
