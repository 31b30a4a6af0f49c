"""Top-k against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopsignals.llm.topk_search import top_k

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType())])


def brute(rows, every, k):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(1024 * x) for x in v])
    out = []
    for q in ok:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(ok[q][0], v)), i) for i, vs in ok.items() if i != q
                       for v in vs if len(v) == len(ok[q][0]))
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def check(spark, rows, every=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % every == 0, **kw).collect()))
    assert got == brute(rows, every, kw.get("k", 10))


def test_matches_brute_force(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(400, 16)).astype("float32") / 4
    v[100:300] = v[100]  # many equal vectors: ties
    rows = [(i, [float(x) for x in v[i]], 0, "x") for i in range(400)]
    rows += [(None, [0.0] * 16, 0, ""), (500, None, 0, ""), (510, [float("nan")] * 16, 0, ""), (520, [None] + [1.0] * 15, 0, ""),
             (530, [float("inf")] * 16, 0, ""), (540, [], 0, ""), (550, [1.0, 2.0], 0, ""), (551, [1.0, 2.0], 0, ""), (552, [], 0, "")]
    check(spark, rows)
    check(spark, rows, k=3, query_block=7)


def test_large_components(spark):
    rnd = random.Random(2)
    check(spark, [(i, [float(np.float32(rnd.uniform(-1, 1) * 2.0 ** 18)) for _ in range(4)], 0, "") for i in range(60)], k=4)


def test_fewer_candidates_than_k_and_none(spark):
    check(spark, [(i, [float(i), 1.0], 0, "") for i in range(4)])
    check(spark, [(0, [1.0], 0, "")])
    check(spark, [])
