"""Exact ranks, samples, closed-form linear models, pages, bulk searches against plain versions."""

import os
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopsignals.operators import linear, ml, pages, ranks
from shopsignals.operators import catalog as ct
from shopsignals.operators import search as se
from shopsignals.operators import sessions as ss
from shopsignals.sources import readers
from shopsignals.streaming import operators as so


def test_medians_of_odd_even_and_tied_values(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, float(rnd.randint(0, 9))]), rnd.gauss(0, 1e6), 7.0 if i % 3 else float(i), None, rnd.randint(-5, 5)) for i in range(1501)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e long").repartition(7)
    for part in (df, df.limit(1500), df.limit(1), df.limit(2)):
        got = ranks.medians(part, list("abcde")).first()
        held = part.toPandas()
        for c in "abcde":
            v = [x for x in held[c] if x == x and x is not None]
            assert got[c] == (statistics.median(v) if v else None)
    assert ranks.medians(df.where("false"), ["a"]).first()["a"] is None
    assert df.select(ranks.median(df, "e").alias("m")).first()["m"] == statistics.median(r[4] for r in rows)


@pytest.mark.parametrize("lo,hi,n", [(0, 50, 200), (-(2**63), 2**63 - 1, 300), (5, 5, 20), (0, 10**12, 1000)])
def test_nth_smallest(spark, lo, hi, n):
    rnd = random.Random(n)
    xs = sorted([rnd.randint(lo, hi) for _ in range(n)] + [lo, hi])
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x long").repartition(5)
    for k in (1, 2, n // 2, n, n + 2):
        assert ranks.nth_smallest(df, F.col("x"), k) == (xs[k - 1], sum(x < xs[k - 1] for x in xs))
    assert ranks.nth_smallest(df, F.col("x"), n + 3) is None


def test_first_rows_and_samples_have_exactly_n_rows(spark):
    df = spark.range(3000).select((F.col("id") % 1000).alias("event_id"), F.col("id").alias("v"), F.timestamp_seconds(F.col("id") % 700).alias("at"),
                                  F.col("id").cast("string").alias("s")).unionByName(spark.createDataFrame([(None, -1, None, None)], "event_id long, v long, at timestamp, s string"))
    rows = sorted((i % 1000, i) for i in range(3000))
    for n in (0, 1, 100, 1001, 2999, 3000, 9999):
        got = readers.head_events(df, n)
        assert sorted((r["event_id"], r["v"]) for r in got.collect()) == rows[:n]
        assert readers.sample_rows(df, "event_id", n).count() == min(n, 3000)
    assert [r["at"] for r in readers.head_events(df, 5, "at").collect()] == [readers.head_events(df, 1, "at").first()["at"]] * 5
    assert readers.head_events(df, 10, "s").count() == 10
    one = {tuple(r) for r in readers.sample_rows(df, "event_id", 700).collect()}
    assert one == {tuple(r) for r in readers.sample_rows(df.repartition(13), "event_id", 700).collect()}
    assert one != {tuple(r) for r in readers.sample_rows(df, "event_id", 700, seed=1).collect()}
    g = readers.sample_groups(df, "event_id", 40)
    assert g.select("event_id").distinct().count() == 40 and g.count() == 120
    plan = readers.head_events(spark.read.parquet(_stored(spark, df)), 50)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(event_id" in plan  # the threshold reaches the scan


def _stored(spark, df):
    import tempfile

    path = os.path.join(tempfile.mkdtemp(prefix="shopsignals-test-"), "t")
    df.write.parquet(path)
    return path


def test_ridge_folds_equal_separate_fits(spark):
    rnd = np.random.default_rng(4)
    n, alpha = 400, 3.0
    x = rnd.normal(size=(n, 3)) * [1, 50, .1] + [0, 2000, 5]
    x[rnd.random(x.shape) < .1] = np.nan
    y = np.nan_to_num(x) @ [2.0, .1, -4.0] + rnd.normal(0, .5, n)
    fold = np.arange(n) % 4
    null = lambda v: None if v != v else float(v)
    df = spark.createDataFrame([(*map(null, r), float(t), int(k)) for r, t, k in zip(x, y, fold)], "a double, b double, c double, y double, k int")
    got = {r["fold"]: (r["n"], r["r2"]) for r in linear.cross_validate_ridge(df, list("abc"), "y", alpha, "k", 4).collect()}
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    for k in range(4):
        tr, te = fold != k, fold == k
        mean, std = filled[tr].mean(0), filled[tr].std(0, ddof=1)
        z = (filled[tr] - mean) / std
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[tr] - y[tr].mean()))
        p = (filled[te] - mean) / std @ w + y[tr].mean()
        assert got[k][0] == te.sum()
        assert abs(got[k][1] - (1 - ((y[te] - p) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())) < 1e-9
    m = ml.train_ridge(df, list("abc"), "y", alpha)
    mean, std = filled.mean(0), filled.std(0, ddof=1)
    z = (filled - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    pred = {round(r["y"], 9): r["prediction"] for r in m.transform(df).collect()}
    assert np.allclose([pred[round(v, 9)] for v in y], z @ w + y.mean(), atol=1e-7)


def test_linear_models_of_odd_tables(spark):
    schema = "a double, b double, y double"
    empty = ml.train_ridge(spark.createDataFrame([], schema), ["a", "b"], "y")
    assert empty.transform(spark.createDataFrame([(1.0, 2.0, 0.0)], schema)).first()["prediction"] == 0.0
    flat = spark.createDataFrame([(1.0, None, 3.0), (1.0, None, 5.0), (None, None, None)], schema)
    assert [r["prediction"] for r in ml.train_ridge(flat, ["a", "b"], "y").transform(flat).collect()] == [4.0] * 3


def test_deep_pages_read_at_most_two_partitions(spark, tmp_dir):
    df = spark.range(2_100_000).select(F.col("id"), (F.col("id") % 1000).alias("score")).repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = pages.store_order(df, [F.col("score").desc(), F.col("id")], os.path.join(tmp_dir, "o"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [d for d in os.listdir(f"{path}/rows") if d.startswith("_part=")]
    assert len(parts) >= 8
    for number in (1, 2, 50_000, 100_000, 105_000, 105_001):
        page = pages.stored_page(spark, path, number, 20)
        at = [(number - 1) * 20 + k for k in range(20) if (number - 1) * 20 + k < 2_100_000]
        want = [(p % 2100 * 1000 + 999 - p // 2100, 999 - p // 2100, p + 1, 2_100_000, 105_000, number < 105_000) for p in at]
        assert sorted(map(tuple, page.collect()), key=lambda r: r[2]) == want
        if at:
            scan = page._jdf.queryExecution().executedPlan().toString()
            chosen = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
            one = re.findall(r"\(_part#\d+ = (\d+)\)", chosen)
            assert 1 <= len(one or re.search(r"IN \(([\d,]+)\)", chosen).group(1).split(",")) <= 2
    none = pages.store_order(df.where("false"), [F.col("id")], os.path.join(tmp_dir, "none"))
    assert pages.stored_page(spark, none).collect() == []
    assert ct.page(df.limit(30), [F.col("id")], 2, 20).count() == 10


def test_brand_search_scores_fewer_pairs(spark):
    rnd = random.Random(6)
    rows = [(i, f"shirt common word{rnd.randint(0, 300)} word{rnd.randint(0, 300)}", f"brand{i % 7}", "cat", "sub") for i in range(2000)]
    cat = spark.createDataFrame(rows, "sku_id long, product_name string, brand string, category string, subcategory string").withColumn("review_count", F.col("sku_id") % 50)
    queries = spark.createDataFrame([(f"q{k}", f"common shirt word{k} word{(k * 7) % 300}") for k in range(40)] + [("only", "common shirt"), ("none", "zzz")], "qid string, query string")
    idx = se.tfidf_index(cat).cache()
    n = cat.count()
    qv = se.query_vectors(queries, idx, n, se.default_stop_words(spark)).cache()
    every = qv.join(idx.select("term", "sku_id", "weight"), "term").groupBy("qid", "sku_id").agg(F.sum(F.col("qweight") * F.col("weight")).alias("score"))
    best = {}
    for r in every.collect():
        key = (-round(r["score"], 12), r["sku_id"])
        best[r["qid"]] = min(best.get(r["qid"], (0, 0)), key) if r["qid"] in best else key
    cand = se.candidate_pairs(idx, qv, 0.05).cache()
    pairs = {(r["qid"], r["sku_id"]) for r in cand.collect()}
    got = se.brand_search(cat, queries, 1).select("qid", "detected_sku", "best_score").collect()
    assert {r["qid"]: r["detected_sku"] for r in got} == {q: s for q, (score, s) in best.items() if -score >= 0.05}
    assert len([p for p in pairs if p[0] != "only"]) < 0.2 * every.where("qid <> 'only'").count()


def test_bulk_search_equals_contains(spark):
    rnd = random.Random(9)
    rows = [(None if i % 50 == 0 else i % 400, "".join(rnd.choice("abÀc ") for _ in range(rnd.randint(0, 12))) if i % 9 else None, rnd.choice(["Xyz%_", "", None, "long TEXT \\d+"]))
            for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(3)
    qs = ["a", "AB", "àc", "abc", "text", "%_", "\\d+", "", None, "nothing here", " ", "yz%_", "b" * 40] + ["".join(rnd.choice("abc") for _ in range(4)) for _ in range(20)]
    q = spark.createDataFrame(list(enumerate(qs)), "qid long, q string")
    got = sorted(map(tuple, se.search_many(df, "id", ["a", "b"], q).collect()))
    assert got == sorted({(k, i) for k, t in enumerate(qs) if t for i, a, b in rows if i is not None and any(x is not None and t.lower() in x.lower() for x in (a, b))})
    assert se.search_many(df, "id", ["a"], q.where("q is null")).collect() == []


def test_mixed_dates(spark):
    given = {"25/01/24": "2024-01-25", "5/1/2024": "2024-01-05", "01/25/24": "2024-01-25", "2024-01-25": "2024-01-25", "2024-1-5T10:00:00": "2024-01-05",
             "25 Jan 2024": "2024-01-25", "25th January, 2024": "2024-01-25", "Jan 25, 2024": "2024-01-25", "Sept 3 99": "1999-09-03", "1.2.70": "1970-02-01",
             "1.2.68": "2068-02-01", "31/02/24": None, "soon": None, "": None, "13/13/2024": None, "2024": None, " 25-12-2023 08:30 ": "2023-12-25", "10 Foo 2024": None}
    df = spark.createDataFrame([(k,) for k in given] + [(None,)], "d string")
    got = {r["d"]: r["x"] for r in df.select("d", ct.mixed_date("d").cast("string").alias("x")).collect()}
    assert got == {**given, None: None}


def test_window_counters_stream_equals_batch(spark, tmp_dir):
    rnd = random.Random(2)
    rows = [(1704067200 + rnd.randint(0, 4 * 3600), f"s{rnd.randint(0, 400)}", rnd.choice(["cart", "page_view", "odd"])) for _ in range(4000)]
    ev = spark.createDataFrame(rows + [(1704067200 + 9 * 3600, "end", "cart")], "t long, session_id string, event_type string").select(
        F.timestamp_seconds("t").alias("timestamp"), "session_id", "event_type")
    d = os.path.join(tmp_dir, "in")
    ev.repartition(3).write.parquet(d)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", "9").parquet(d)
    q = (so.live_window_kpis(stream, delay="6 hours").writeStream.format("memory").queryName("k7_windows").outputMode("append")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["window_start"]: r for r in spark.table("k7_windows").collect()}
    want = {r["window_start"]: r for r in ss.window_kpis(ev).collect()}
    exact = ["window_end", "events", "cart", "page_view", "purchase"]
    assert len(got) > 10 and all([r[c] for c in exact] == [want[w][c] for c in exact] for w, r in got.items())
    assert all(abs(r["active_sessions"] - want[w]["active_sessions"]) <= 0.06 * want[w]["active_sessions"] + 1 for w, r in got.items())
    batch = {r["window_start"]: r for r in so.live_window_kpis(ev).collect()}
    assert set(batch) == set(want) and all([r[c] for c in exact] == [want[w][c] for c in exact] for w, r in batch.items())


def test_bulk_search_answer_crosses_no_shuffle(spark):
    # 400 copies of three names asked for by 400 copies of two queries: 320,000 answers
    df = spark.range(1200).select("id", F.expr("concat('Name#0000', id % 3)").alias("a"), F.lit("seg").alias("b"))
    q = spark.range(800).select(F.col("id").alias("qid"), F.expr("concat('#000', id % 2)").alias("q"))
    q = q.unionByName(spark.range(800, 1200).select(F.col("id").alias("qid"), F.lit("name#00002").alias("q")))
    out = se.search_many(df, "id", ["a", "b"], q)
    assert out.count() == 400 * 1200 + 400 * 400  # '#0001' finds nothing
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and "_b" not in plan[plan.index("Join"):].split("Generate")[0]
    assert not any(w in plan[:plan.index("Join")] for w in ("Exchange", "Aggregate"))


def test_bulk_search_repeated_and_null_ids(spark):
    rows = [(1, "alpha beta gamma", "x"), (1, "beta", None), (2, "alpha beta gamma", "x"), (3, "x", "alpha beta gamma"), (4, None, None), (None, "beta", "x")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    qs = [(1, "beta"), (1, "alpha beta"), (1, "beta"), (None, "x"), (None, "a beta gam"), (5, "ALPHA"), (6, "alpha"), (7, "alpha beta gamma delta"), (8, "beta gamma"), (8, "x")]
    q = spark.createDataFrame(qs, "qid long, q string")
    got = sorted(map(tuple, se.search_many(df, "id", ["a", "b"], q).collect()), key=str)
    assert got == sorted({(k, i) for k, t in qs for i, a, b in rows if i is not None and any(x is not None and t.lower() in x for x in (a, b))}, key=str)
