"""The keyed table against a dict, its cost, replays, versions and expiry."""

import os

import pytest
from pyspark.sql import functions as F

from shopsignals.sources import keyed_table as K
from shopsignals.sources import sinks

SCHEMA = "k long, ts long, v string"


def _files(path):
    """(path below, bytes) of all Parquet files."""
    return [(os.path.relpath(f, path), os.path.getsize(f)) for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names)
            if f.endswith(".parquet")]


def _rows(df):
    return {r["k"]: (r["ts"], r["v"]) for r in df.collect()}


def test_sizes_fall_geometrically():
    sizes, rewritten = [], 0
    for _ in range(1000):  # new keys only: the table grows without end
        sizes.append(10)
        n = K.to_merge(sizes)
        if n:
            rewritten += sum(sizes[-n:])
            sizes[-n:] = [sum(sizes[-n:])]
        assert all(a >= K.FACTOR * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 10
    assert rewritten <= 10 * 1000 * 10 and sum(sizes) == 10_000


def test_fifty_batches_bound_files_bytes_and_work(spark, tmp_dir):
    path, buckets, keys, per = os.path.join(tmp_dir, "t"), 4, 2000, 200
    table = K.KeyedTable(spark, path, "k", ["ts"], buckets=buckets)
    want, written = {}, []
    snapshot = None
    for b in range(50):
        batch = spark.range(per).select(((F.col("id") * 37 + b * 611) % keys).alias("k"), F.lit(b).cast("long").alias("ts"),
                                        F.concat(F.lit(f"{b}-"), F.sha2(F.col("id").cast("string"), 256)).alias("v"))
        before = set(n for n, _ in _files(f"{path}/data"))
        table.upsert(batch.coalesce(2), b)
        written.append(sum(s for n, s in _files(f"{path}/data") if n not in before))
        want.update({(i * 37 + b * 611) % keys: b for i in range(per)})
        if b == 20:
            snapshot = dict(want)
    got = _rows(table.read())
    assert {k: ts for k, (ts, _) in got.items()} == want
    m = table.manifest()
    live = [size for fs in m["files"].values() for _, size in fs]
    assert set(m["files"]) == {str(b) for b in range(buckets)}
    assert max(len(fs) for fs in m["files"].values()) <= 8
    whole = os.path.join(tmp_dir, "whole")
    table.read().coalesce(buckets).write.parquet(whole)
    one = sum(s for _, s in _files(whole))
    assert sum(live) <= 3 * one
    on_disk = _files(f"{path}/data")
    assert len(on_disk) <= buckets * 8 * (K.KEEP + 1) and len(table.versions()) <= K.KEEP
    # the batches' cost is a few times their own size on average, not the table's
    first = written[0]
    assert sum(written) <= 50 * 8 * first
    assert snapshot and len(snapshot) < len(want)


def test_replays_and_old_versions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    table = K.KeyedTable(spark, path, "k", ["ts", "v"], buckets=3)
    assert table.read() is None
    table.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 1, "z"), (None, 9, "n")], SCHEMA), 0)
    held = table.read()
    one = spark.createDataFrame([(1, 2, "c"), (3, 1, "d"), (2, 0, "late")], SCHEMA)
    table.upsert(one, 1)
    state = (table.manifest(), sorted(_files(path)))
    table.upsert(spark.createDataFrame([(1, 99, "other")], SCHEMA), 1)  # known id: nothing happens
    table.upsert(spark.createDataFrame([(1, 99, "other")], SCHEMA), 0)
    assert (table.manifest(), sorted(_files(path))) == state
    assert _rows(table.read()) == {1: (2, "c"), 2: (1, "b"), 3: (1, "d")}
    assert _rows(held) == _rows(table.read(version=0)) == {1: (1, "z"), 2: (1, "b")}  # a reader keeps its version
    table.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert _rows(table.read()) == {1: (2, "c"), 2: (1, "b"), 3: (1, "d")}
    assert table.manifest()["batch_id"] == 2


def test_failed_attempts_leave_nothing(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "t")
    table = K.KeyedTable(spark, path, "k", ["ts"], buckets=2)
    table.upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA), 0)
    with monkeypatch.context() as m:
        m.setattr(K._Files, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert(spark.createDataFrame([(1, 2, "half"), (5, 2, "half")], SCHEMA), 1)
    assert _rows(table.read()) == {1: (1, "a")}
    table.upsert(spark.createDataFrame([(1, 2, "b")], SCHEMA), 1)
    assert _rows(table.read()) == {1: (2, "b")}
    files = {n for n, _ in _files(f"{path}/data")}
    m = table.manifest()
    named = {n.removeprefix("data/") for fs in m["files"].values() for n, _ in fs} | {n.removeprefix("data/") for _, n in m["gone"]}
    assert files == named
    version = m["version"]
    with pytest.raises(RuntimeError, match="another writer"):
        table.files.commit(f"{path}/manifest/{version:020d}.json", "{}")


def test_keys_read_only_their_buckets(spark, tmp_dir):
    table = K.KeyedTable(spark, os.path.join(tmp_dir, "t"), ["k", "v"], ["ts"], buckets=8)
    table.upsert(spark.range(400).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("ts"), F.lit("x").alias("v")), 0)
    some = table.read(spark.createDataFrame([(7, "x"), (7, "x"), (9999, "x")], "k long, v string"))
    assert [tuple(r) for r in some.collect()] == [(7, 1, "x")]
    assert 1 <= len(some.inputFiles()) <= 2 < len(table.read().inputFiles())


def test_expiry_and_added_columns(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    run = sinks.upsert_latest(path, "k", ["at"], buckets=1, ttl_seconds=60, time_col="at")

    def batch(rows, b, cols="k long, t string, v string"):
        df = spark.createDataFrame(rows, cols)
        run(df.withColumn("at", F.to_timestamp("t")).drop("t"), b)

    def alive(**kw):
        return {r["k"]: r["v"] for r in sinks.read_latest(spark, path, **kw).collect()}
    batch([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:30", "b")], 0)
    assert alive() == {1: "a", 2: "b"}
    batch([(3, "2024-01-01 00:01:00", "c")], 1)
    assert alive() == {2: "b", 3: "c"}
    assert alive(as_of="2024-01-01 00:00:59").items() >= {2: "b", 3: "c"}.items()  # a merge may have dropped the first
    assert alive(as_of="2024-01-01 00:10:00") == {}
    batch([(1, "2024-01-01 00:05:00", "again", 1.5)], 2, "k long, t string, v string, w double")
    assert [(r["k"], r["v"], r["w"]) for r in sinks.read_latest(spark, path).collect()] == [(1, "again", 1.5)]
    for b in range(3, 6):
        batch([(10 + b, "2024-01-01 00:05:01", "x")], b)
    table = K.KeyedTable(spark, path)
    raw = table._scan(table.manifest(), [n for fs in table.manifest()["files"].values() for n, _ in fs])
    assert raw.where("k in (2, 3)").count() == 0  # merges dropped the expired rows
    with pytest.raises(ValueError, match="column v"):
        batch([(1, "2024-01-01 00:06:00", 5)], 9, "k long, t string, v long")


def test_log_of_a_retried_batch_is_written_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    day = lambda d, p: spark.createDataFrame([(p, f"2024-01-0{d} 10:00:00")], "price double, ts string").select("price", F.to_timestamp("ts").alias("timestamp"))
    both = day(1, 1.0).unionAll(day(2, 2.0))
    for b, df in ((0, both), (0, both), (1, day(2, 3.0)), (0, both)):
        sinks.log_prices(df, path, batch_id=b)
    assert sorted((r["price"], str(r["date"]), r["batch_id"]) for r in spark.read.parquet(path).collect()) == [
        (1.0, "2024-01-01", 0), (2.0, "2024-01-02", 0), (3.0, "2024-01-02", 1)]
