"""Cart and order tables.

``cart_state`` folds a cart log without a per-key loop: only events after
the last reset of a key matter (a reset is a remove / set ≤ 0 of the key or a
clear / order of the whole cart), and what is left is aggregates per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsignals.functions.columns import first_nonzero, round_to
from shopsignals.session import materialize

# The storefront vouchers, in listing order.
# (code, type, value, min_cart, max_discount, needs_electronics)
VOUCHERS = [
    ("WELCOME10", "percentage", 10.0, 0.0, 500.0, False),
    ("FLAT500", "flat", 500.0, 2000.0, 500.0, False),
    ("ELECTRONICS15", "category_percentage", 15.0, 5000.0, 2000.0, True),
    ("SAVE20", "percentage", 20.0, 10000.0, 3000.0, False),
]
# a cart "has electronics" when any item category contains one of these
ELECTRONICS_WORDS = ["electronics", "computers", "smartphones", "appliances"]

_ORDER = ("timestamp", "event_id")


def _key(*cols) -> Column:
    return F.struct(*[F.col(c) for c in cols])


# ------------------------------------------------------------------------- L1
def cart_state(log: DataFrame, attrs: tuple = ("price",)) -> DataFrame:
    """L1: current cart lines (email, product_id, quantity, *attrs).

    log: (event_id, timestamp, email, product_id, action, quantity, *attrs);
    actions add (+qty, attributes kept from the first add), set (=qty; only
    on an existing line; ≤ 0 removes), remove / delete, clear / order (empty
    the email's cart).
    """
    ev = materialize(log.select(_key(*_ORDER).alias("_k"), "email", "product_id", "action", "quantity", *attrs))  # read once
    email_reset = (ev.where(F.col("action").isin("clear", "order"))
                   .groupBy("email").agg(F.max("_k").alias("_re")))
    key_ev = ev.where(F.col("product_id").isNotNull() & ~F.col("action").isin("clear", "order"))
    is_reset = F.col("action").isin("remove", "delete") | ((F.col("action") == "set") & (F.col("quantity") <= 0))
    key_reset = (key_ev.where(is_reset).groupBy("email", "product_id").agg(F.max("_k").alias("_rk")))
    j = (key_ev.join(email_reset, "email", "left").join(key_reset, ["email", "product_id"], "left"))
    after = (F.col("_re").isNull() | (F.col("_k") > F.col("_re"))) & \
            (F.col("_rk").isNull() | (F.col("_k") > F.col("_rk")))
    live = j.where(after & F.col("action").isin("add", "set"))
    is_add = F.col("action") == "add"
    is_set = (F.col("action") == "set") & (F.col("quantity") > 0)
    first = live.groupBy("email", "product_id").agg(
        F.min(F.when(is_add, F.col("_k"))).alias("_a0"),
        F.max(F.when(is_set, F.col("_k"))).alias("_s"),
        F.max_by(F.when(is_set, F.col("quantity")), F.when(is_set, F.col("_k"))).alias("_sq"),
        F.min_by(F.struct(*[F.col(a) for a in attrs]), F.when(is_add, F.col("_k"))).alias("_attrs"))
    first = first.where(F.col("_a0").isNotNull())
    set_ok = F.col("_s").isNotNull() & (F.col("_s") > F.col("_a0"))
    first = first.withColumn("_cut", F.when(set_ok, F.col("_s")))
    adds = (live.where(is_add).select("email", "product_id", "_k", "quantity")
            .join(first.select("email", "product_id", "_cut"), ["email", "product_id"])
            .where(F.col("_cut").isNull() | (F.col("_k") > F.col("_cut")))
            .groupBy("email", "product_id").agg(F.sum(F.coalesce("quantity", F.lit(1))).alias("_adds")))
    out = first.join(adds, ["email", "product_id"], "left")
    qty = F.when(set_ok, F.col("_sq")).otherwise(F.lit(0)) + F.coalesce(F.col("_adds"), F.lit(0))
    return out.select("email", "product_id", qty.cast("bigint").alias("quantity"),
                      *[F.col(f"_attrs.{a}").alias(a) for a in attrs])


# ------------------------------------------------------------------------- D24
def cart_totals(lines: DataFrame, price: Column | str = "price") -> DataFrame:
    """Per email Σ price × quantity (missing price 0, missing qty 1) and item count."""
    p = F.coalesce(F.col(price) if isinstance(price, str) else price, F.lit(0.0))
    q = F.coalesce(F.col("quantity"), F.lit(1))
    return lines.groupBy("email").agg(F.sum(p * q).alias("total"), F.sum(q).cast("bigint").alias("item_count"),
                                      F.count(F.lit(1)).cast("bigint").alias("n_lines"))


def effective_price(price: str = "price", best: str = "best_price", predicted: str = "predicted_price",
                    base: str = "base_price") -> Column:
    """First non-zero of price, best, predicted, base; else 0."""
    return first_nonzero(price, best, predicted, base)


# ------------------------------------------------------------------------- L2
def _order_id(as_of: str) -> Column:
    """Order id = hash of (email, order time) (rule Q12: ids by second collide)."""
    return F.xxhash64(F.col("email").cast("string"), F.lit(as_of))


def orders_from_carts(lines: DataFrame, as_of: str, price: Column | str = "price") -> DataFrame:
    """L2: one order header per email from its cart lines: item count, total
    rounded to 2, status completed. An aggregate per email (combined
    map-side); the lines themselves are ``order_lines``, not an array."""
    p = F.coalesce(F.col(price) if isinstance(price, str) else price, F.lit(0.0))
    q = F.coalesce(F.col("quantity"), F.lit(1))
    g = lines.groupBy("email").agg(F.count(F.lit(1)).cast("bigint").alias("n_items"),
                                   round_to(F.sum(p * q), 2).alias("total"))
    ts = F.lit(as_of).cast("timestamp")
    return g.select(_order_id(as_of).alias("order_id"), "email", "n_items", "total", ts.alias("created_at"),
                    F.lit("completed").alias("status"))


def order_lines(lines: DataFrame, as_of: str, price: Column | str = "price") -> DataFrame:
    """L2 items in long form: (order_id, email, product_id, price, quantity)."""
    p = F.coalesce(F.col(price) if isinstance(price, str) else price, F.lit(0.0))
    q = F.coalesce(F.col("quantity"), F.lit(1))
    return lines.select(_order_id(as_of).alias("order_id"), "email", "product_id", p.alias("price"),
                        q.alias("quantity"))


# ------------------------------------------------------------------------- E9
def best_voucher(carts: DataFrame, vouchers=VOUCHERS) -> DataFrame:
    """E9 + C9: best voucher per cart (subtotal, has_electronics).

    The theta join with the vouchers is a fold over a literal voucher array
    inside each row — no join, no shuffle. Largest saving wins, the first
    listed wins ties, a saving must be > 0; total = max(0, subtotal − saving).
    """
    vs = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias("code"), F.lit(t).alias("type"),
                            F.lit(float(v)).alias("value"), F.lit(float(mc)).alias("min_cart"),
                            F.lit(float(md)).alias("max_discount"), F.lit(ne).alias("needs"))
                   for i, (c, t, v, mc, md, ne) in enumerate(vouchers)])
    sub = F.col("subtotal")

    def saving(v):
        ok = (sub >= v["min_cart"]) & (~v["needs"] | F.col("has_electronics"))
        amt = F.when(v["type"] == "flat", F.least(v["value"], v["max_discount"])).otherwise(
            F.least(sub * v["value"] / 100.0, v["max_discount"]))
        return F.when(ok, amt).otherwise(F.lit(0.0))

    init = F.struct(F.lit(None).cast("string").alias("code"), F.lit(0.0).alias("savings"))
    best = F.aggregate(vs, init, lambda acc, v: F.when(saving(v) > acc["savings"],
                                                       F.struct(v["code"].alias("code"), saving(v).alias("savings")))
                       .otherwise(acc))
    x = carts.withColumn("_b", best)
    return x.select("*", F.col("_b.code").alias("voucher"), F.col("_b.savings").alias("savings"),
                    F.greatest(F.lit(0.0), sub - F.col("_b.savings")).alias("total")).drop("_b")


def cart_summary(lines: DataFrame, price: str = "price", category: str = "category") -> DataFrame:
    """Per email subtotal and the electronics flag used by ``best_voucher``."""
    cat = F.lower(F.coalesce(F.col(category), F.lit("")))
    elec = None
    for w in ELECTRONICS_WORDS:
        e = cat.contains(w)
        elec = e if elec is None else (elec | e)
    p = F.coalesce(F.col(price), F.lit(0.0))
    q = F.coalesce(F.col("quantity"), F.lit(1))
    return lines.groupBy("email").agg(F.sum(p * q).alias("subtotal"), F.max(elec).alias("has_electronics"))


# ------------------------------------------------------------------------ B24
def valid_coupons(coupons: DataFrame, as_of, email: str | None = None, days: int = 30) -> DataFrame:
    """Coupons usable at ``as_of``: active, used_count < usage_limit, not
    expired (created + ``days`` when no expiry), offer price > 0, code of 4+
    characters; codes trimmed/upper-cased, emails trimmed/lower-cased."""
    t = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    expiry = (F.col("expiry_date") if "expiry_date" in coupons.columns
              else F.lit(None).cast("timestamp"))
    expiry = F.coalesce(expiry, F.col("created_at") + F.expr(f"INTERVAL {int(days)} DAYS"))
    c = coupons.select("*", F.upper(F.trim("code")).alias("norm_code"),
                       F.lower(F.trim("user_email")).alias("norm_email"), expiry.alias("expires_at"))
    ok = (F.coalesce(F.col("is_active"), F.lit(True)) & (F.col("used_count") < F.col("usage_limit"))
          & (F.col("expires_at") > t) & (F.col("offer_price") > 0) & (F.length("norm_code") >= 4))
    if email is not None:
        ok = ok & (F.col("norm_email") == email.strip().lower())
    return c.where(ok)
