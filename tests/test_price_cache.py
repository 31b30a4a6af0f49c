"""I4: the batch price cache by successor chains against a sequential cache."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shopsignals.operators import pricing as pr

SCHEMA = "event_id long, timestamp timestamp, product_id long, user_id long, base_price double, final_price double, reason string"


def _requests(seed, n, spread, users=1, exact=False):
    rnd = random.Random(seed)
    at, out = datetime(2024, 1, 1), []
    for e in range(n):
        at += timedelta(seconds=rnd.choice([0, 60, 59, 1] if exact else spread), microseconds=0 if exact else rnd.randint(0, 10**6 - 1))
        out.append((e, at, 1, rnd.randint(1, users), 100.0, 50.0 + e % 41, f"r{e}"))
    return out


def _sequential(rows, ttl=60):
    cache, out = {}, {}
    for e, at, p, u, base, price, reason in sorted(rows, key=lambda r: (r[1] or datetime.min, r[0])):
        if at is None:
            out[e] = (price, reason, False)
            continue
        held = cache.get((p, u))
        hit = held is not None and at < held[0] + timedelta(seconds=ttl)
        if not hit:
            held = cache[p, u] = (at, price, reason)
        out[e] = (held[1], held[2], hit)
    return out


@pytest.mark.parametrize("rows", [
    _requests(1, 4000, [0, 0, 1, 2]),                 # one stretch without a pause holds every request
    _requests(2, 1500, [0, 5, 30, 61, 200], users=3),
    _requests(3, 1200, [], exact=True),               # equal times, and steps of exactly the time to live
    [], [(1, None, 1, 1, 100.0, 3.0, "x"), (2, datetime(2024, 1, 1), 1, 1, 100.0, 4.0, "y")]])
def test_cache_equals_a_sequential_one(spark, rows):
    out = pr.serve_cached(spark.createDataFrame(rows, SCHEMA).repartition(6), 60)
    got = {r["event_id"]: (r["final_price"], r["reason"], r["cache_hit"]) for r in out.collect()}
    assert got == _sequential(rows)
    assert all(abs(r["discount_pct"] - (100 - r["final_price"])) < 1e-9 for r in out.collect())


def test_no_python_and_no_task_with_a_whole_stretch(spark):
    df = spark.createDataFrame(_requests(1, 2000, [0, 1]), SCHEMA)
    out = pr.serve_cached(df, 60)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    assert out.where(~F.col("cache_hit")).count() == sum(not h for _, _, h in _sequential(_requests(1, 2000, [0, 1])).values())
