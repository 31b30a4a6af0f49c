"""Shared output contract for registered queries.

A query's final projection is described once as a spec of (name, kind) and
rendered both as a DataFrame projection (Spark) and as an SQL select list
(oracle), so names, types and rounding agree by construction.

kinds: ``d`` double rounded to 4 places as round(x·1e4)/1e4 — the same
       IEEE steps in both engines — with negative zero cleared,
       ``i`` bigint, ``s`` string, ``b`` boolean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spec(text: str) -> list[tuple[str, str]]:
    """Parse ``"a:s b:i c:d"`` into [(a, s), (b, i), (c, d)]."""
    out = []
    for tok in text.split():
        n, k = tok.rsplit(":", 1)
        out.append((n, k))
    return out


def finalize(df: DataFrame, sp: list[tuple[str, str]] | str) -> DataFrame:
    sp = spec(sp) if isinstance(sp, str) else sp
    cols = []
    for n, k in sp:
        c = F.col(n)
        if k == "d":
            c = F.round(c.cast("double") * F.lit(10000.0)) / F.lit(10000.0) + F.lit(0.0)
        elif k == "i":
            c = c.cast("bigint")
        elif k == "s":
            c = c.cast("string")
        elif k == "b":
            c = c.cast("boolean")
        cols.append(c.alias(n))
    return df.select(*cols)


def select_sql(sp: list[tuple[str, str]] | str, src: str) -> str:
    sp = spec(sp) if isinstance(sp, str) else sp
    items = []
    for n, k in sp:
        if k == "d":
            items.append(f"round(CAST({n} AS DOUBLE) * 10000.0) / 10000.0 + 0.0 AS {n}")
        elif k == "i":
            items.append(f"CAST({n} AS BIGINT) AS {n}")
        elif k == "s":
            items.append(f"CAST({n} AS VARCHAR) AS {n}")
        elif k == "b":
            items.append(f"CAST({n} AS BOOLEAN) AS {n}")
    return "SELECT " + ", ".join(items) + f" FROM {src}"
