"""Scalar column functions (section B). All JVM-side expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# B2 demand scale (unknown type → 1)
DEMAND_WEIGHTS = {
    "page_view": 1, "product_view": 2, "search": 1, "add_to_cart": 4,
    "add_to_wishlist": 3, "checkout_start": 5, "purchase": 7,
    "remove_from_cart": -1, "page_exit": 0,
}
# B3 popularity scale (unknown type → 1)
POPULARITY_WEIGHTS = {
    "page_view": 1, "product_view": 2, "search": 1, "add_to_cart": 3,
    "add_to_wishlist": 2, "checkout_start": 4, "purchase": 5,
    "remove_from_cart": 0, "page_exit": 0,
}
# B4 live scale (unknown type → 0.05)
LIVE_WEIGHTS = {
    "page_view": 0.05, "search": 0.10, "cart": 0.40, "purchase": 1.00,
    "wishlist": 0.25,
}
# K2 intent base per live event type (purchase has no entry → 0.05)
INTENT_BASE = {"cart": 0.65, "wishlist": 0.40, "search": 0.20, "page_view": 0.08}
# B5 coarse relabel (unknown → view)
COARSE_EVENT = {
    "page_view": "view", "product_view": "view", "search": "view",
    "add_to_cart": "cart", "add_to_wishlist": "cart", "checkout_start": "cart",
    "purchase": "purchase", "remove_from_cart": "view", "page_exit": "view",
}
BATCH_EVENT_TYPES = list(DEMAND_WEIGHTS)
LIVE_EVENT_TYPES = list(LIVE_WEIGHTS)
_DEFAULTS = {"demand": 1.0, "popularity": 1.0, "live": 0.05}
_SCALES = {"demand": DEMAND_WEIGHTS, "popularity": POPULARITY_WEIGHTS, "live": LIVE_WEIGHTS}


def lookup(col: Column | str, table: dict, default) -> Column:
    """Literal map lookup with a default (a CASE that codegen inlines)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in table.items():
        expr = (F.when(c == F.lit(k), F.lit(v)) if expr is None
                else expr.when(c == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def event_weight(col: Column | str, scale: str = "demand") -> Column:
    """Event weight on the named scale, as double."""
    return lookup(col, _SCALES[scale], _DEFAULTS[scale]).cast("double")


def coarse_event_type(col: Column | str) -> Column:
    """View / cart / purchase."""
    return lookup(col, COARSE_EVENT, "view")


def slug(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.replace(F.replace(F.lower(c), F.lit(" & "), F.lit("_")), F.lit(" "), F.lit("_"))


def category_code(cat: Column | str, sub: Column | str) -> Column:
    """slug(category) + '.' + slug(subcategory)."""
    return F.concat(slug(cat), F.lit("."), slug(sub))


def safe_float(col: Column | str, default: float = 0.0) -> Column:
    """Parse as double, default when unparseable or null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.try_cast("double"), F.lit(default).cast("double"))


def safe_int(col: Column | str, default: int = 0) -> Column:
    """Parse as integer (via double, like int(float(x))), default otherwise."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def first_nonzero(*cols: Column | str, default: float = 0.0) -> Column:
    """First argument that is neither null nor zero."""
    cs = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in cols]
    return F.coalesce(*cs, F.lit(default).cast("double"))


def to_usd(col: Column | str, rate: float = 0.012) -> Column:
    """INR → USD, 2 decimals."""
    c = F.col(col) if isinstance(col, str) else col
    return round_to(c * F.lit(rate), 2)


def clip(col: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    c = F.col(col) if isinstance(col, str) else col
    out = c
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def round_to(col: Column | str, digits: int = 2) -> Column:
    """Round half away from zero as scale → round → unscale.

    The same IEEE steps run in any SQL engine, so results agree across Spark
    and the oracle; differs from Python's binary ``round`` only at exact ties.
    """
    c = F.col(col) if isinstance(col, str) else col
    k = float(10 ** digits)
    return F.round(c.cast("double") * F.lit(k)) / F.lit(k)
