"""Registry of named queries: Spark builder + DuckDB oracle SQL.

Each query reads the fixture views over the given tables (see
``shopsignals.sources.fixtures``), calls library operators and ends in a
``finalize`` projection; the oracle is the same question in ANSI SQL over the
same views (as CTEs) ending in the same select list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopsignals.plans.output import finalize, select_sql, spec
from shopsignals.sources.fixtures import cte, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SPECS: dict[str, list] = {}


def query(name: str, out: str, oracle: str | None = None, views: tuple = ()):
    """Register ``fn(fx) -> DataFrame`` where ``fx(view_name)`` gives a fixture view.

    ``oracle`` is the body SQL producing a relation ``q``-compatible select;
    it is wrapped with the fixture CTEs and the shared final projection.
    """
    sp = spec(out)

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(lambda n: view(spark, sf_dir, n)), sp)

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        SPECS[name] = sp
        if oracle is not None:
            ORACLE[name] = (cte(*views) + ", _q AS (" + oracle.strip() + ")\n"
                            + select_sql(sp, "_q")) if views else \
                ("WITH _q AS (" + oracle.strip() + ")\n" + select_sql(sp, "_q"))
        return fn

    return deco


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    from shopsignals.plans import (  # noqa: F401
        q_catalog,
        q_features,
        q_ml,
        q_ops,
        q_pricing,
        q_recommend,
        q_scalar,
        q_sessions,
    )
