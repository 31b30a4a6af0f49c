"""Catalog operators: cleaning, features, cards, search, top-k, paging (B, D13/D15/D23, E2–E4, F)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignals.functions.columns import category_code, coarse_event_type, round_to
from shopsignals.operators.ranks import median


# ------------------------------------------------------------------------- B1
def active_flag(col: Column | str) -> Column:
    """TRUE/FALSE/1/0 (any case, bool or string) → boolean; unknown or null → true."""
    c = F.upper(F.trim((F.col(col) if isinstance(col, str) else col).cast("string")))
    return F.when(c.isin("FALSE", "0"), F.lit(False)).otherwise(F.lit(True))


def clean_catalog(df: DataFrame) -> DataFrame:
    """B1: keep active rows and apply the display defaults."""
    out = df.where(active_flag("is_active")) if "is_active" in df.columns else df
    defaults = {"category": F.lit("Other"), "subcategory": F.lit("General"),
                "brand": F.lit("Generic"), "product_name": F.lit("Product"),
                "avg_rating": F.lit(0.0), "review_count": F.lit(0),
                "inventory_count": F.lit(0), "image_url": F.lit("")}
    cols = []
    for c in out.columns:
        if c == "is_active":
            cols.append(F.lit(True).alias(c))
        elif c in defaults:
            cols.append(F.coalesce(F.col(c), defaults[c]).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


# ------------------------------------------------------------------------- B8
def tags_count(col: Column | str) -> Column:
    """Number of quoted entries in a Python list literal; 0 when not a list."""
    c = F.col(col) if isinstance(col, str) else col
    is_list = F.coalesce(c.rlike(r"^\s*\[.*\]\s*$"), F.lit(False))
    n = F.size(F.regexp_extract_all(c, F.lit(r"'[^']*'|\"[^\"]*\""), 0))
    return F.when(is_list, n).otherwise(F.lit(0))


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def mixed_date(col: Column | str) -> Column:
    """A date written in any of the usual ways, the day first where that makes a
    date: 25/01/24, 25-1-2024, 01/25/24 (no month 25: the month first), 2024-01-25
    (with or without a time), 25 Jan 2024, 25th January, 2024, Jan 25, 2024.
    Two-digit years from 69 on are of the last century. NULL for anything else."""
    text = F.trim((F.col(col) if isinstance(col, str) else col).cast("string"))
    end = r"(?:[T\s].*)?$"

    def found(pattern: str, *groups: int) -> list[Column]:
        return [F.regexp_extract(text, pattern, g) for g in groups]

    def date(y: Column, m: Column, d: Column) -> Column:
        year = F.when(F.length(y) == 2, F.concat(F.when(y < "69", F.lit("20")).otherwise(F.lit("19")), y)).otherwise(y)
        return F.try_to_date(F.concat_ws("-", year, m, d), "yyyy-M-d")

    def month(name: Column) -> Column:
        return F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(name, 1, 3))).cast("string")

    d, m, y = found(r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})" + end, 1, 2, 3)
    iy, im, iday = found(r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})" + end, 1, 2, 3)
    dd, dm, dy = found(r"^(\d{1,2})(?:st|nd|rd|th)?[\s\-./]+([A-Za-z]{3,9})\.?,?[\s\-./]+(\d{4}|\d{2})" + end, 1, 2, 3)
    mm, md, my = found(r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4}|\d{2})" + end, 1, 2, 3)
    return F.coalesce(date(y, m, d), date(y, d, m), date(iy, im, iday), date(dy, month(dm), dd), date(my, month(mm), md))


def price_model_features(df: DataFrame, year_fill: str = "zero") -> DataFrame:
    """launch_year (``mixed_date``; bad → 0, or the median with ``year_fill='median'``),
    tags_count, is_active flag, price_margin, inventory_value, rating_weighted."""
    year = F.year(mixed_date("launch_date"))
    if year_fill == "median":
        year = F.coalesce(year.cast("double"), median(df.select(year.alias("year")), "year"), F.lit(0.0))
    else:
        year = F.coalesce(year, F.lit(0)).cast("double")
    return (df.withColumn("launch_year", year)
              .withColumn("tags_count", tags_count("tags"))
              .withColumn("is_active_flag",
                          F.when(F.upper(F.col("is_active").cast("string")) == "TRUE", 1).otherwise(0))
              .withColumn("price_margin", F.col("base_price_usd") - F.col("cost_price_usd"))
              .withColumn("inventory_value", F.col("inventory_count") * F.col("cost_price_usd"))
              .withColumn("rating_weighted", F.col("avg_rating") * F.col("review_count")))


# ------------------------------------------------------------------------- B9
def label_encode(df: DataFrame, cols: list[str], fill: str = "Unknown") -> DataFrame:
    """Sorted distinct labels → 0-based index, joined back per column.

    The label dictionary is a distinct over one column (one shuffle, sized by
    the number of labels, not rows); positions come from a range sort with
    per-partition offsets, never a single-partition window. Unseen/NULL labels
    map through ``fill``.
    """
    from shopsignals.operators.sessions import dense_index

    out = df
    for c in cols:
        labels = out.select(F.coalesce(F.col(c), F.lit(fill)).alias("_lab")).distinct()
        codes = dense_index(labels, "_lab", f"{c}_code").withColumn(f"{c}_code", F.col(f"{c}_code").cast("int"))
        out = (out.withColumn("_lab", F.coalesce(F.col(c), F.lit(fill)))
                  .join(codes, "_lab", "left").drop("_lab")
                  .withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(0))))
    return out


# ------------------------------------------------------------------------ B10
def product_card(df: DataFrame) -> DataFrame:
    """Display projection of a catalog row."""
    cur = F.coalesce(F.col("current_price_usd"), F.col("base_price_usd"), F.lit(0.0))
    return df.select(
        F.col("sku_id").cast("string").alias("product_id"),
        F.coalesce(F.col("product_name"),
                   F.concat_ws(" ", F.col("brand"), F.col("subcategory"))).alias("name"),
        F.coalesce(F.col("category"), F.lit("Other")).alias("category"),
        F.coalesce(F.col("subcategory"), F.lit("General")).alias("subcategory"),
        F.coalesce(F.col("brand"), F.lit("Generic")).alias("brand"),
        round_to(cur, 2).alias("base_price"),
        round_to(F.coalesce(F.col("base_price_usd"), cur), 2).alias("original_price"),
        F.concat_ws(" ", F.coalesce(F.col("brand"), F.lit("Generic")),
                    F.coalesce(F.col("subcategory"), F.lit("General"))).alias("description"),
        F.coalesce(F.col("inventory_count"), F.lit(0)).cast("bigint").alias("stock"),
        F.coalesce(F.col("avg_rating"), F.lit(0.0)).cast("double").alias("avg_rating"),
        F.coalesce(F.col("review_count"), F.lit(0)).cast("bigint").alias("review_count"),
        F.coalesce(F.col("review_count"), F.lit(0)).cast("bigint").alias("popularity"),
    )


# ------------------------------------------------------------------------ B11
def search_catalog(df: DataFrame, category: str | None = None, subcategory: str | None = None,
                   q: str | None = None, skus: list | None = None,
                   cols=("product_name", "brand", "category"), limit: int | None = None) -> DataFrame:
    """Case-insensitive filters and literal substring search (rule Q10);
    ``limit``: only that many, by sku_id (type-ahead)."""
    out = df
    if category:
        out = out.where(F.lower(F.col("category")) == category.lower())
    if subcategory:
        out = out.where(F.lower(F.col("subcategory")) == subcategory.lower())
    if q:
        cond = None
        for c in cols:
            hit = F.coalesce(F.lower(F.col(c).cast("string")).contains(q.lower()), F.lit(False))
            cond = hit if cond is None else (cond | hit)
        out = out.where(cond)
    if skus is not None:
        out = out.where(F.col("sku_id").isin(list(skus)))
    return out if limit is None else out.orderBy("sku_id").limit(limit)


# ------------------------------------------------------------------------ B14
def search_text(df: DataFrame, q: str, cols: list[str]) -> DataFrame:
    """Admin search — any of ``cols`` contains ``q`` (case-insensitive)."""
    return search_catalog(df, q=q, cols=tuple(cols))


def public_users(primary: DataFrame, fallback: DataFrame, hidden=("password",)) -> DataFrame:
    """User listing without secret columns; the fallback table is used
    only when the primary one is empty (decided by a one-row existence probe)."""
    def strip(d):
        return d.select(*[c for c in d.columns if c not in hidden])
    p, f = strip(primary), strip(fallback)
    has_primary = p.limit(1).count() > 0
    return p if has_primary else f


# ------------------------------------------------------------------------ B22
def legacy_events(clicks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coarse relabel + category_code + brand per event.

    The catalog side is one row per SKU; the join is left on sku so events of
    unknown SKUs keep "unknown" / NULL-brand semantics ("generic").
    """
    cat = catalog.select(F.col("sku_id").alias("_sku"),
                         category_code(F.coalesce("category", F.lit("unknown")),
                                       F.coalesce("subcategory", F.lit("unknown"))).alias("_code"),
                         F.coalesce(F.col("brand"), F.lit("generic")).alias("_brand"))
    j = clicks.join(cat, clicks["sku_id"] == cat["_sku"], "left")
    return j.select(
        F.col("sku_id").alias("product_id"), "user_id",
        coarse_event_type("event_type").alias("event_type"),
        F.col("price_seen_usd").alias("price"),
        F.when(F.col("_sku").isNull(), F.lit("unknown")).otherwise(F.col("_code")).alias("category_code"),
        F.when(F.col("_sku").isNull(), F.lit("generic")).otherwise(F.col("_brand")).alias("brand"),
    )


# ------------------------------------------------------------------------ B23


# ------------------------------------------------------------------------ D13
def stock_value_by_category(catalog: DataFrame, n: int = 10) -> DataFrame:
    """Σ base × inventory per category, top n, rounded to 2."""
    v = F.coalesce(F.col("base_price_usd"), F.lit(0.0)) * F.coalesce(F.col("inventory_count"), F.lit(0))
    return (catalog.where(F.col("category").isNotNull()).groupBy("category")
            .agg(round_to(F.sum(v), 2).alias("stock_value"))
            .orderBy(F.col("stock_value").desc(), F.col("category")).limit(n))


# ------------------------------------------------------------------------ D15
def low_stock(catalog: DataFrame, lt: int = 10, n: int = 10) -> DataFrame:
    """Inventory < lt (NULL → 0), the n lowest."""
    inv = F.coalesce(F.col("inventory_count"), F.lit(0))
    # filter with missing stock as 0, sort by the raw value (missing last), tie → sku
    top = (catalog.where(inv < lt)
           .orderBy(F.col("inventory_count").asc_nulls_last(), F.col("sku_id")).limit(n))
    return top.select(F.col("sku_id"), F.col("product_name"), inv.cast("bigint").alias("inventory_count"))


# ------------------------------------------------------------------------ D23
def category_tree_flat(catalog: DataFrame) -> DataFrame:
    """D23 in long form: (category, subcategory, position, sub_count)."""
    d = catalog.where(F.col("category").isNotNull() & F.col("subcategory").isNotNull()) \
        .select("category", "subcategory").distinct()
    w = Window.partitionBy("category")
    return (d.withColumn("position", F.row_number().over(w.orderBy("subcategory")))
             .withColumn("sub_count", F.count(F.lit(1)).over(w)))


def brand_list(catalog: DataFrame) -> DataFrame:
    """Sorted distinct brands with their position."""
    from shopsignals.operators.sessions import dense_index

    d = catalog.where(F.col("brand").isNotNull()).select("brand").distinct()
    return dense_index(d, "brand", "position", start=1)


# ------------------------------------------------------------------- E2 / E3 / E4
def first_per_key(df: DataFrame, key: str | list, order: list) -> DataFrame:
    """The first row per key in a stated order (drop_duplicates keep-first)."""
    keys = [key] if isinstance(key, str) else list(key)
    if all(isinstance(o, str) for o in order):
        from shopsignals.operators.topk import first_per_group

        return first_per_group(df, keys, order)  # aggregate: combined map-side
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_products(catalog: DataFrame, n: int = 20) -> DataFrame:
    """Top n by review_count (tie-break sku_id), one row per SKU."""
    d = first_per_key(catalog, "sku_id", [F.col("review_count").desc()])
    return (d.orderBy(F.col("review_count").desc(), F.col("sku_id")).limit(n)
             .withColumn("rank", F.row_number().over(
                 Window.orderBy(F.col("review_count").desc(), F.col("sku_id")))))


def top_by_category(catalog: DataFrame, n: int = 10) -> DataFrame:
    """Top n per category by review_count."""
    from shopsignals.operators.topk import top_k_per_group

    return top_k_per_group(catalog, ["category"], [F.col("review_count").desc(), F.col("sku_id")], n)


def trending(catalog: DataFrame, n: int = 5) -> DataFrame:
    """Reviews × rating, rank label "#k"."""
    d = catalog.withColumn("trending_score", F.col("review_count") * F.col("avg_rating"))
    d = first_per_key(d, "sku_id", [F.col("trending_score").desc()])
    order = [F.col("trending_score").desc(), F.col("sku_id")]
    top = d.orderBy(*order).limit(n)
    return (top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
               .withColumn("trending_rank", F.concat(F.lit("#"), F.col("rank").cast("string")))
               .withColumn("view_count", F.col("review_count")))


# ------------------------------------------------------------------------ F1–F3
def page(df: DataFrame, order: list, page_no: int = 1, limit: int = 20) -> DataFrame:
    """one page in a total order, with total, total_pages and has_more.

    The page is ``offset + limit`` over a sort (TakeOrdered for small offsets;
    for deep pages see ``pages.store_order``);
    the total (``total_rows``) is a scalar subquery (a count), not a second driver round-trip.
    """
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    start = (page_no - 1) * limit
    rows = df.orderBy(*order).offset(start).limit(limit) if start else df.orderBy(*order).limit(limit)
    pages = F.greatest(F.lit(1), F.ceil(total / F.lit(limit)))
    return (rows.withColumn("position", F.row_number().over(Window.orderBy(*order)) + F.lit(start))
                .withColumn("total_rows", total)
                .withColumn("total_pages", pages)
                .withColumn("has_more", F.lit(start + limit) < total))
