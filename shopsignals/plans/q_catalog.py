"""Registered queries: catalog cleaning, cards, search, top-k and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from shopsignals.operators import catalog as ct
from shopsignals.operators import pages
from shopsignals.operators import search as se
from shopsignals.plans.registry import query

CAT = ("fx_catalog",)
ACTIVE = ("fx_catalog_active",)


def _active(fx):
    """The service-layer catalog: active rows with display defaults (B1)."""
    return ct.clean_catalog(fx("fx_catalog"))


@query("b1_clean_catalog",
       "sku_id:i product_name:s category:s subcategory:s brand:s avg_rating:d review_count:i "
       "inventory_count:i is_active:b", views=CAT, oracle="""
SELECT sku_id, coalesce(product_name, 'Product') AS product_name, coalesce(category, 'Other') AS category,
 coalesce(subcategory, 'General') AS subcategory, coalesce(brand, 'Generic') AS brand,
 coalesce(avg_rating, 0) AS avg_rating, coalesce(review_count, 0) AS review_count,
 coalesce(inventory_count, 0) AS inventory_count, true AS is_active
FROM fx_catalog WHERE upper(trim(CAST(is_active AS VARCHAR))) NOT IN ('FALSE', '0')""")
def b1(fx):
    """B1: active rows with display defaults."""
    return ct.clean_catalog(fx("fx_catalog"))


@query("b8_price_model_features",
       "sku_id:i launch_year:d tags_count:i is_active_flag:i price_margin:d inventory_value:d rating_weighted:d",
       views=CAT, oracle=r"""
SELECT sku_id, CAST(coalesce(year(try_strptime(launch_date, '%d/%m/%y')), 0) AS DOUBLE) AS launch_year,
 CASE WHEN regexp_matches(tags, '^\s*\[.*\]\s*$') THEN len(regexp_extract_all(tags, '''[^'']*''|"[^"]*"')) ELSE 0 END AS tags_count,
 CASE WHEN upper(is_active) = 'TRUE' THEN 1 ELSE 0 END AS is_active_flag,
 base_price_usd - cost_price_usd AS price_margin, inventory_count * cost_price_usd AS inventory_value,
 avg_rating * review_count AS rating_weighted
FROM fx_catalog""")
def b8(fx):
    """Model features from the catalog (date parse, tag count, products)."""
    return ct.price_model_features(fx("fx_catalog"))


@query("b8_mixed_dates", "sku_id:i launch_day:s launch_year:i", views=("fx_mixed_dates",), oracle="""
WITH t AS (SELECT sku_id, CAST(try_strptime(launch_date, ['%d/%m/%y', '%d/%m/%Y', '%m/%d/%y', '%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%d-%m-%Y', '%d %b %Y', '%b %d, %Y']) AS DATE) AS day
 FROM fx_mixed_dates)
SELECT sku_id, CAST(day AS VARCHAR) AS launch_day, coalesce(year(day), 0) AS launch_year FROM t""")
def b8_mixed(fx):
    """Launch dates in mixed formats, the day first where that is a date."""
    day = ct.mixed_date("launch_date")
    return fx("fx_mixed_dates").select("sku_id", day.cast("string").alias("launch_day"), F.coalesce(F.year(day), F.lit(0)).alias("launch_year"))


@query("b9_label_encode", "sku_id:i category_code:i subcategory_code:i brand_code:i", views=CAT, oracle="""
SELECT sku_id, dense_rank() OVER (ORDER BY coalesce(category, 'Unknown')) - 1 AS category_code,
 dense_rank() OVER (ORDER BY coalesce(subcategory, 'Unknown')) - 1 AS subcategory_code,
 dense_rank() OVER (ORDER BY coalesce(brand, 'Unknown')) - 1 AS brand_code
FROM fx_catalog""")
def b9(fx):
    """Sorted-label integer codes."""
    return ct.label_encode(fx("fx_catalog"), ["category", "subcategory", "brand"])


_CARD = ("product_id:s name:s category:s subcategory:s brand:s base_price:d original_price:d "
         "description:s stock:i avg_rating:d review_count:i popularity:i")
_CARD_SQL = """
SELECT CAST(sku_id AS VARCHAR) AS product_id, coalesce(product_name, concat_ws(' ', brand, subcategory)) AS name,
 coalesce(category, 'Other') AS category, coalesce(subcategory, 'General') AS subcategory,
 coalesce(brand, 'Generic') AS brand, round(coalesce(current_price_usd, base_price_usd, 0) * 100.0) / 100.0 AS base_price,
 round(coalesce(base_price_usd, current_price_usd, 0) * 100.0) / 100.0 AS original_price,
 concat_ws(' ', coalesce(brand, 'Generic'), coalesce(subcategory, 'General')) AS description,
 coalesce(inventory_count, 0) AS stock, coalesce(avg_rating, 0) AS avg_rating,
 coalesce(review_count, 0) AS review_count, coalesce(review_count, 0) AS popularity"""


@query("b10_product_card", _CARD, views=ACTIVE, oracle=_CARD_SQL + " FROM fx_catalog_active")
def b10(fx):
    """Product card projection."""
    return ct.product_card(_active(fx))


@query("b11_search_catalog", "sku_id:i product_name:s category:s subcategory:s brand:s", views=ACTIVE,
       oracle="""
SELECT sku_id, product_name, category, subcategory, brand FROM fx_catalog_active
WHERE lower(category) = 'standard' AND (contains(lower(product_name), 'ring') OR contains(lower(brand), 'ring')
 OR contains(lower(category), 'ring'))
UNION ALL
SELECT sku_id, product_name, category, subcategory, brand FROM fx_catalog_active
WHERE lower(subcategory) = 'small-3' AND contains(lower(brand), 'brand#1')
UNION ALL
(SELECT sku_id, product_name, category, subcategory, brand FROM fx_catalog_active
WHERE contains(lower(brand), 'brand') ORDER BY sku_id LIMIT 5)""")
def b11(fx):
    """Category filter + substring search, subcategory + brand search, type-ahead."""
    cat = _active(fx).select("sku_id", "product_name", "category", "subcategory", "brand")
    a = ct.search_catalog(cat, category="STANDARD", q="Ring")
    b = ct.search_catalog(cat, subcategory="SMALL-3", q="brand#1")
    return a.unionByName(b).unionByName(ct.search_catalog(cat, q="brand", cols=("brand",), limit=5))


@query("b14_search_users", "c_custkey:i c_name:s c_mktsegment:s", oracle="""
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), '00001')
 OR contains(lower(c_mktsegment), '00001')""")
def b14(fx):
    """Admin user search over name and segment."""
    cust = fx("customer").select("c_custkey", "c_name", "c_mktsegment")
    return ct.search_text(cust, "00001", ["c_name", "c_mktsegment"])


@query("b11_search_many", "qid:s sku_id:i", views=ACTIVE, oracle="""
WITH q AS (SELECT DISTINCT upper(substr(p_name, 2, 1 + p_partkey % 6)) AS q FROM part UNION SELECT 'no such thing' UNION SELECT '#1')
SELECT DISTINCT q AS qid, sku_id FROM q JOIN fx_catalog_active ON q <> '' AND (contains(lower(product_name), lower(q)) OR contains(lower(brand), lower(q))
 OR contains(lower(category), lower(q)))""")
def b11_many(fx):
    """B11 in bulk: fragments of all part names, one to six letters, against name, brand and category."""
    part = fx("part").select(F.upper(F.expr("substr(p_name, 2, 1 + p_partkey % 6)")).alias("q"))
    more = part.sparkSession.createDataFrame([("no such thing",), ("#1",)], "q string")
    q = part.unionByName(more).distinct().select(F.col("q").alias("qid"), "q")
    return se.search_many(_active(fx), "sku_id", ["product_name", "brand", "category"], q)


@query("b14_search_many", "qid:i c_custkey:i", oracle="""
WITH q AS (SELECT c_custkey AS qid, substr(c_name, -4) AS q FROM customer)
SELECT qid, c.c_custkey FROM q JOIN customer c ON contains(lower(c.c_name), lower(q)) OR contains(lower(c.c_mktsegment), lower(q))""")
def b14_many(fx):
    """B14 in bulk: the last four characters of every customer's name against all names and segments."""
    q = fx("customer").select(F.col("c_custkey").alias("qid"), F.expr("substr(c_name, -4)").alias("q"))
    return se.search_many(fx("customer"), "c_custkey", ["c_name", "c_mktsegment"], q)


_LEGACY_SQL = """
SELECT e.sku_id AS product_id, e.user_id, CASE e.event_type WHEN 'page_view' THEN 'view' WHEN 'product_view' THEN 'view'
 WHEN 'search' THEN 'view' WHEN 'add_to_cart' THEN 'cart' WHEN 'add_to_wishlist' THEN 'cart'
 WHEN 'checkout_start' THEN 'cart' WHEN 'purchase' THEN 'purchase' ELSE 'view' END AS event_type,
 e.price_seen_usd AS price,
 CASE WHEN c.sku_id IS NULL THEN 'unknown' ELSE
  replace(replace(lower(coalesce(c.category, 'unknown')), ' & ', '_'), ' ', '_') || '.' ||
  replace(replace(lower(coalesce(c.subcategory, 'unknown')), ' & ', '_'), ' ', '_') END AS category_code,
 CASE WHEN c.sku_id IS NULL THEN 'generic' ELSE coalesce(c.brand, 'generic') END AS brand
FROM fx_clickstream e LEFT JOIN fx_catalog c ON e.sku_id = c.sku_id"""


@query("b22_legacy_events", "product_id:i user_id:i event_type:s price:d category_code:s brand:s",
       views=("fx_clickstream", "fx_catalog"), oracle=_LEGACY_SQL)
def b22(fx):
    """Legacy event export with coarse types and category codes."""
    return ct.legacy_events(fx("fx_clickstream"), fx("fx_catalog"))


@query("d13_stock_value_by_category", "category:s stock_value:d", views=CAT, oracle="""
SELECT category, round(sum(coalesce(base_price_usd, 0) * coalesce(inventory_count, 0)) * 100.0) / 100.0 AS stock_value
FROM fx_catalog WHERE category IS NOT NULL GROUP BY category ORDER BY stock_value DESC, category LIMIT 10""")
def d13(fx):
    """Stock value by category, top 10."""
    return ct.stock_value_by_category(fx("fx_catalog"), 10)


@query("d15_low_stock", "sku_id:i product_name:s inventory_count:i", views=CAT, oracle="""
SELECT sku_id, product_name, coalesce(inventory_count, 0) AS inventory_count FROM
 (SELECT * FROM fx_catalog WHERE coalesce(inventory_count, 0) < 10
  ORDER BY inventory_count ASC NULLS LAST, sku_id LIMIT 10)""")
def d15(fx):
    """The ten lowest-stock products under 10 units."""
    return ct.low_stock(fx("fx_catalog"), 10, 10)


@query("d23_category_tree", "category:s subcategory:s position:i sub_count:i", views=ACTIVE, oracle="""
SELECT category, subcategory, row_number() OVER (PARTITION BY category ORDER BY subcategory) AS position,
 count(*) OVER (PARTITION BY category) AS sub_count
FROM (SELECT DISTINCT category, subcategory FROM fx_catalog_active WHERE category IS NOT NULL AND subcategory IS NOT NULL)""")
def d23(fx):
    """Category → sorted subcategories (flattened)."""
    return ct.category_tree_flat(_active(fx))


@query("d23_brand_list", "brand:s position:i", views=ACTIVE, oracle="""
SELECT brand, row_number() OVER (ORDER BY brand) AS position FROM (SELECT DISTINCT brand FROM fx_catalog_active
WHERE brand IS NOT NULL)""")
def d23b(fx):
    """Sorted brand list."""
    return ct.brand_list(_active(fx))


@query("e2_top_products", "sku_id:i review_count:i rank:i", views=ACTIVE, oracle="""
SELECT sku_id, review_count, row_number() OVER (ORDER BY review_count DESC, sku_id) AS rank
FROM fx_catalog_active ORDER BY review_count DESC, sku_id LIMIT 20""")
def e2(fx):
    """Global top 20 by reviews."""
    return ct.top_products(_active(fx), 20)


@query("e2_top_by_category", "category:s sku_id:i review_count:i rank:i", views=ACTIVE, oracle="""
SELECT * FROM (SELECT category, sku_id, review_count,
 row_number() OVER (PARTITION BY category ORDER BY review_count DESC, sku_id) AS rank FROM fx_catalog_active)
WHERE rank <= 10""")
def e2c(fx):
    """Top 10 per category."""
    return ct.top_by_category(_active(fx), 10)


@query("e3_trending", "sku_id:i trending_score:d rank:i trending_rank:s view_count:i", views=ACTIVE, oracle="""
SELECT sku_id, review_count * avg_rating AS trending_score,
 row_number() OVER (ORDER BY review_count * avg_rating DESC, sku_id) AS rank,
 '#' || CAST(row_number() OVER (ORDER BY review_count * avg_rating DESC, sku_id) AS VARCHAR) AS trending_rank,
 review_count AS view_count
FROM fx_catalog_active ORDER BY trending_score DESC, sku_id LIMIT 5""")
def e3(fx):
    """Trending top 5 with rank labels."""
    return ct.trending(_active(fx), 5)


@query("e4_first_per_key", "product_id:i order_id:i email:i price:d", views=("fx_orders",), oracle="""
SELECT product_id, order_id, email, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id
 ORDER BY created_at, order_id, price, quantity) AS rn FROM fx_orders) WHERE rn = 1""")
def e4(fx):
    """First order line per product (earliest order, then order id)."""
    return ct.first_per_key(fx("fx_orders"), "product_id", ["created_at", "order_id", "price", "quantity"])


@query("e4_product_meta", "product_id:i category_code:s brand:s", views=("fx_clickstream", "fx_catalog"),
       oracle=f"SELECT DISTINCT product_id, category_code, brand FROM ({_LEGACY_SQL})")
def e4m(fx):
    """E4 + B22 + A8: product meta (product → category code, brand) from the
    legacy export. Both attributes depend on the product only, so its first
    row is any row: an aggregate per product, combined map-side."""
    leg = ct.legacy_events(fx("fx_clickstream"), fx("fx_catalog"))
    return ct.first_per_key(leg.select("product_id", "category_code", "brand"), "product_id",
                            ["category_code", "brand"])


_PAGE_OUT ="sku_id:i review_count:i position:i total_rows:i total_pages:i has_more:b"


@query("f1_page_by_reviews", _PAGE_OUT, views=ACTIVE, oracle="""
SELECT sku_id, review_count, row_number() OVER (ORDER BY review_count DESC, sku_id) AS position,
 (SELECT count(*) FROM fx_catalog_active) AS total_rows,
 greatest(1, ceil((SELECT count(*) FROM fx_catalog_active) / 20)) AS total_pages,
 60 < (SELECT count(*) FROM fx_catalog_active) AS has_more
FROM fx_catalog_active ORDER BY review_count DESC, sku_id LIMIT 20 OFFSET 40""")
def f1(fx):
    """third page of 20 by review count."""
    return ct.page(_active(fx).select("sku_id", "review_count"),
                   [F.col("review_count").desc(), F.col("sku_id")], 3, 20)


@query("f2_page_filtered", _PAGE_OUT, views=ACTIVE, oracle="""
WITH f AS (SELECT sku_id, coalesce(review_count, 0) AS review_count FROM fx_catalog_active WHERE lower(category) = 'promo')
SELECT sku_id, review_count, row_number() OVER (ORDER BY sku_id) AS position,
 (SELECT count(*) FROM f) AS total_rows, greatest(1, ceil((SELECT count(*) FROM f) / 25)) AS total_pages,
 50 < (SELECT count(*) FROM f) AS has_more
FROM f ORDER BY sku_id LIMIT 25 OFFSET 25""")
def f2(fx):
    """category-filtered page 2 in key order with total_pages."""
    cat = ct.search_catalog(_active(fx), category="promo").select("sku_id", "review_count")
    return ct.page(cat, [F.col("sku_id")], 2, 25)


@query("f3_page_orders", "order_id:i email:i total:d position:i total_rows:i has_more:b", oracle="""
WITH o AS (SELECT o_orderkey AS order_id, o_custkey AS email, o_totalprice AS total, o_orderdate AS created_at
 FROM orders)
SELECT order_id, email, total, row_number() OVER (ORDER BY created_at DESC, order_id) AS position,
 (SELECT count(*) FROM o) AS total_rows, 40 < (SELECT count(*) FROM o) AS has_more
FROM o ORDER BY created_at DESC, order_id LIMIT 20 OFFSET 20""")
def f3(fx):
    """the admin order history over all orders, newest first, page 2 of 20."""
    o = fx("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("email"),
                            F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("created_at"))
    return ct.page(o, [F.col("created_at").desc(), F.col("order_id")], 2, 20)


@query("f1_deep_page", _PAGE_OUT, views=ACTIVE, oracle="""
SELECT sku_id, review_count, row_number() OVER (ORDER BY review_count DESC, sku_id) AS position, (SELECT count(*) FROM fx_catalog_active) AS total_rows,
 greatest(1, ceil((SELECT count(*) FROM fx_catalog_active) / 20)) AS total_pages, 1000 < (SELECT count(*) FROM fx_catalog_active) AS has_more
FROM fx_catalog_active ORDER BY review_count DESC, sku_id LIMIT 20 OFFSET 980""")
def f1_deep(fx):
    """F1 on a stored order: the fiftieth page of 20 by review count."""
    cat = _active(fx).select("sku_id", "review_count")
    return pages.stored_page(cat.sparkSession, pages.store_order(cat, [F.col("review_count").desc(), F.col("sku_id")]), 50, 20)


@query("f3_deep_page", "order_id:i email:i total:d position:i total_rows:i has_more:b", oracle="""
WITH o AS (SELECT o_orderkey AS order_id, o_custkey AS email, o_totalprice AS total, o_orderdate AS created_at FROM orders)
SELECT order_id, email, total, row_number() OVER (ORDER BY created_at DESC, order_id) AS position,
 (SELECT count(*) FROM o) AS total_rows, 10020 < (SELECT count(*) FROM o) AS has_more
FROM o ORDER BY created_at DESC, order_id LIMIT 20 OFFSET 10000""")
def f3_deep(fx):
    """F3 on a stored order: page 501 of 20 of the order history, newest first."""
    o = fx("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("email"),
                            F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("created_at"))
    return pages.stored_page(o.sparkSession, pages.store_order(o, [F.col("created_at").desc(), F.col("order_id")]), 501, 20)
