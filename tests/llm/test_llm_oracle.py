"""Queries with SQL against DuckDB on the given tables; the others run whole."""

import pytest
from paths import SF

from shopsignals.llm.queries import ORACLE, QUERIES
from tools.oracle_check import canon, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    rel = duck(SF).sql(ORACLE[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
