"""Every registered query with an oracle equals its DuckDB SQL (values rounded
to 4 places by the shared output spec), like the driver's correctness check."""

import pytest

from tests.conftest import SF_ORACLE

import __spark_entry__ as E  # noqa: E402

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_every_query_has_a_callable():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 80


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    from tools.oracle_check import canon, duck

    df = QUERIES[name](spark, SF_ORACLE)
    srows = [tuple(r) for r in df.collect()]
    res = duck(SF_ORACLE).execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    a, ac = canon(df.columns, srows)
    b, bc = canon(ocols, res.fetchall())
    assert ac == bc
    assert len(a) == len(b)
    assert a == b


def test_switching_scale_dirs_in_one_session(spark):
    from tests.conftest import SF_SMALL

    q = QUERIES["d11_total_revenue"]
    big = q(spark, SF_ORACLE).first()["order_count"]
    small = q(spark, SF_SMALL).first()["order_count"]
    again = q(spark, SF_ORACLE).first()["order_count"]
    assert small < big == again


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "product_id" in df.columns and "price_factor" in df.columns
