"""Fixture views: the reference's input shapes derived from the test tables.

Each view is plain SQL accepted by both Spark and DuckDB, so the same text
feeds the Spark queries (as temp views over the Parquet scans) and the DuckDB
oracle (as CTEs). Attributes the base tables lack are deterministic formulas
on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

VIEWS: dict[str, str] = {
    "fx_catalog": """
SELECT p_partkey AS sku_id, p_name AS product_name, p_type AS category,
 concat(p_type, '-', CAST(p_size % 5 AS STRING)) AS subcategory, p_brand AS brand,
 p_retailprice AS base_price_usd, p_retailprice * 0.6e0 AS cost_price_usd,
 p_retailprice * (0.9e0 + CAST(p_partkey % 21 AS DOUBLE) / 100e0) AS current_price_usd,
 p_retailprice * 0.75e0 AS min_price_usd, p_retailprice * 1.25e0 AS max_price_usd,
 CASE WHEN p_partkey % 29 = 11 THEN NULL ELSE (p_partkey * 37) % 600 END AS inventory_count,
 CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 30 + 1 END AS restock_days,
 CASE WHEN p_partkey % 23 = 7 THEN NULL ELSE CAST((p_partkey * 7) % 41 + 10 AS DOUBLE) / 10e0 END AS avg_rating,
 CASE WHEN p_partkey % 31 = 9 THEN NULL WHEN p_partkey % 20 = 0 THEN 900 ELSE (p_partkey * 13) % 500 END AS review_count,
 CAST(p_size AS DOUBLE) / 10e0 AS weight_kg,
 concat(lpad(CAST(p_partkey % 28 + 1 AS STRING),2,'0'),'/',lpad(CAST(p_partkey % 12 + 1 AS STRING),2,'0'),'/',lpad(CAST(p_partkey % 5 + 20 AS STRING),2,'0')) AS launch_date,
 concat('[''', replace(p_name, ' ', ''', '''), ''']') AS tags,
 CASE WHEN p_partkey % 20 = 0 THEN 'FALSE' ELSE 'TRUE' END AS is_active FROM part""",
    "fx_clickstream": """
SELECT e.event_id, e.ts AS timestamp, e.user_id, e.k AS sku_id,
 CASE WHEN e.event_id % 97 <> 5 THEN concat(CAST(e.user_id AS STRING), '-', CAST(CAST(e.ts AS DATE) AS STRING)) END AS session_id,
 CASE WHEN e.event_type = 'view' AND e.event_id % 7 = 1 THEN 'page_view' WHEN e.event_type = 'view' AND e.event_id % 7 = 2 THEN 'add_to_wishlist'
  WHEN e.event_type = 'click' AND e.event_id % 5 = 1 THEN 'checkout_start' WHEN e.event_type = 'click' AND e.event_id % 5 = 2 THEN 'remove_from_cart'
  WHEN e.event_type = 'view' THEN 'product_view' WHEN e.event_type = 'click' THEN 'add_to_cart' WHEN e.event_type = 'signup' THEN 'search' WHEN e.event_type = 'error' THEN 'page_exit' ELSE e.event_type END AS event_type,
 CASE WHEN e.event_id % 53 <> 3 THEN e.value END AS price_seen_usd, e.k % 5 + 1 AS quantity, e.value * 6e0 AS session_duration_s,
 CAST(e.event_id % 101 AS DOUBLE) AS scroll_depth_pct, e.value * 2e0 AS time_on_page_s,
 c.c_mktsegment AS user_segment, CASE e.event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device_type,
 CASE e.event_id % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'email' WHEN 2 THEN 'social' ELSE 'direct' END AS referral_source,
 EXTRACT(HOUR FROM e.ts) AS hour_of_day
 FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "fx_competitor": """
SELECT l_partkey AS sku_id, concat('S', CAST(l_suppkey AS STRING)) AS competitor, CASE WHEN l_orderkey % 41 <> 6 THEN l_extendedprice / l_quantity END AS competitor_price,
 (l_extendedprice / l_quantity - p_retailprice) / p_retailprice * 100e0 AS price_delta_pct,
 CASE WHEN l_discount >= 0.05e0 THEN 1 ELSE 0 END AS is_on_promotion, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS in_stock, l_shipdate AS timestamp
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 37 <> 4""",
    "fx_profiles": """
SELECT c_custkey AS user_id, c_mktsegment AS segment, 0.7e0 + CAST(c_custkey % 41 AS DOUBLE) / 100e0 AS willingness_to_pay_multiplier,
 c_acctbal AS lifetime_value_usd, c_acctbal / 10e0 AS avg_order_value_usd, CAST(c_custkey % 100 AS DOUBLE) / 100e0 AS cart_abandonment_rate,
 CAST(c_custkey % 12 AS DOUBLE) AS purchase_frequency, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
 CASE c_custkey % 4 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-49' ELSE '50+' END AS age_group, n_name AS country
 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fx_orders": """
SELECT o_orderkey AS order_id, o_custkey AS email, l_partkey AS product_id, l_quantity AS quantity, l_extendedprice / l_quantity AS price, o_totalprice AS total, o_orderdate AS created_at, o_orderstatus AS status
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "fx_live_clicks": """
SELECT event_id, timestamp, user_id, session_id, sku_id AS product_id,
 CASE event_type WHEN 'product_view' THEN 'page_view' WHEN 'add_to_cart' THEN 'cart' WHEN 'page_exit' THEN 'wishlist' WHEN 'add_to_wishlist' THEN 'wishlist' ELSE event_type END AS event_type FROM fx_clickstream""",
    "fx_cart_log": """
SELECT event_id, timestamp, user_id AS email, sku_id % 10 AS product_id,
 CASE WHEN event_type IN ('add_to_cart', 'product_view', 'page_view', 'add_to_wishlist', 'checkout_start') THEN 'add' WHEN event_type = 'search' THEN 'set'
  WHEN event_type IN ('page_exit', 'remove_from_cart') THEN 'remove' ELSE 'order' END AS action,
 CASE WHEN event_type = 'search' THEN sku_id % 4 ELSE 1 END AS quantity, price_seen_usd * 10e0 AS price FROM fx_clickstream""",
    # each cart event asks for its price again 20, 60 and 75 s later, the middle two from a session without features
    "fx_price_requests": """
SELECT event_id * 4 AS event_id, timestamp, user_id, session_id, product_id FROM fx_live_clicks WHERE event_type = 'cart'
UNION ALL SELECT event_id * 4 + 1, timestamp + INTERVAL 20 SECOND, user_id, session_id || '-new', product_id FROM fx_live_clicks WHERE event_type = 'cart'
UNION ALL SELECT event_id * 4 + 2, timestamp + INTERVAL 60 SECOND, user_id, session_id || '-new', product_id FROM fx_live_clicks WHERE event_type = 'cart'
UNION ALL SELECT event_id * 4 + 3, timestamp + INTERVAL 75 SECOND, user_id, session_id, product_id FROM fx_live_clicks WHERE event_type = 'cart'""",
    # launch dates written in eleven ways, some of them no date
    "fx_mixed_dates": """
SELECT sku_id, CASE k WHEN 0 THEN concat(d, '/', m, '/', substr(y, 3, 2)) WHEN 1 THEN concat(d, '/', m, '/', y) WHEN 2 THEN concat(y, '-', m, '-', d)
 WHEN 3 THEN concat(d, ' ', mon, ' ', y) WHEN 4 THEN concat(mon, ' ', d, ', ', y) WHEN 5 THEN concat(m, '/', CAST(CAST(d AS INT) % 10 + 15 AS STRING), '/', substr(y, 3, 2))
 WHEN 6 THEN concat(y, '-', m, '-', d, ' 10:11:12') WHEN 7 THEN concat(d, '-', m, '-', y) WHEN 8 THEN 'soon' WHEN 9 THEN '31/02/24' ELSE concat(d, '/', m, '/98') END AS launch_date
 FROM (SELECT sku_id, sku_id % 11 AS k, lpad(CAST(sku_id % 28 + 1 AS STRING), 2, '0') AS d, lpad(CAST(sku_id % 12 + 1 AS STRING), 2, '0') AS m,
  CAST(2019 + sku_id % 6 AS STRING) AS y, substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((sku_id % 12) * 3 + 1 AS INT), 3) AS mon FROM fx_catalog) x""",
    # the service-layer catalog: active rows only (what clean_catalog keeps)
    "fx_catalog_active": """
SELECT * FROM fx_catalog WHERE upper(trim(is_active)) NOT IN ('FALSE', '0')""",
    "fx_vouchers": """
SELECT * FROM (VALUES (1,'WELCOME10','percentage',10e0,0e0,500e0,0),(2,'FLAT500','flat',500e0,2000e0,500e0,0),
 (3,'ELECTRONICS15','category_percentage',15e0,5000e0,2000e0,1),(4,'SAVE20','percentage',20e0,10000e0,3000e0,0)) AS t(pos, code, type, value, min_cart, max_discount, needs_category)""",
    "fx_time_scenarios": """
SELECT * FROM (VALUES (20,1.10e0),(14,1.00e0),(4,0.90e0),(8,0.98e0)) AS t(hour_of_day, time_multiplier)""",
    "fx_coupons": """
SELECT concat(' save', CAST(c_custkey AS STRING), ' ') AS code, lower(c_name) AS user_email, c_acctbal AS offer_price, c_custkey % 7 <> 0 AS is_active,
 1 AS usage_limit, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS used_count, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at FROM customer""",
}

# fixture views that read other fixture views
_DEPS = {"fx_live_clicks": ["fx_clickstream"], "fx_cart_log": ["fx_clickstream"], "fx_price_requests": ["fx_live_clicks"],
         "fx_catalog_active": ["fx_catalog"], "fx_mixed_dates": ["fx_catalog"]}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def cte(*views: str) -> str:
    """``WITH`` clause defining the named fixture views (and what they read)."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in _closure(views)]
    return "WITH " + ",\n".join(parts) + "\n"


def register(spark: SparkSession, sf_dir: str) -> None:
    """Register the base tables of ``sf_dir`` and every fixture view."""
    # temp views are session-global: re-register whenever the dir changes
    if _registered.get(id(spark)) == sf_dir and spark.catalog.tableExists("fx_catalog"):
        return
    for t in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for n in _closure(VIEWS):
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {n} AS {VIEWS[n]}")
    _registered[id(spark)] = sf_dir


_registered: dict[int, str] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)
