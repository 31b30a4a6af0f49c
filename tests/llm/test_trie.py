"""Prefix trie of conversations against a plain walk."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from shopsignals.llm import prefix_trie as P
from shopsignals.llm.queries import QUERIES
from tests.conftest import SF_ORACLE, SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            conv[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in conv.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(turns.get(base, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq) == d))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        m = sorted(members[p])
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        out[p] = (m[0][0], len(p), min(members[p[:-1]])[0] if p else None, len(m), len(children[p]),
                  sum(out[q][5] for q in children[p]) or 1, own + sum(out[q][6] for q in children[p]),
                  hashlib.sha256(",".join(str(c) for c, e in m if e).encode()).hexdigest())
    return sorted(out.values(), key=str)


def got(df):
    return sorted(map(tuple, P.rebuilt_trie(df).collect()), key=str)


def conversations(seed, n):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-12, 6 * n), n):
        for t in range(rnd.choice([0, 1, 2, 4, 9, 14])):
            rows.append((c, None if t == 0 and rnd.random() < .2 else t, rnd.choice(["user", "bot", None, ""]),
                         rnd.choice(["é", "b", "", None]) if t else "hi"))
    return rows


def test_trie_equals_a_plain_walk(spark):
    for seed, n in ((1, 40), (2, 150)):
        rows = conversations(seed, n)
        assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_given_conversations(spark):
    for sf in (SF_SMALL, SF_ORACLE):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        res = QUERIES["op12_prefix_trie"](spark, sf)
        assert res.columns == names and dict(res.dtypes)["n_leaves"] == "bigint"
        assert sorted(map(tuple, res.collect()), key=str) == plain(rows)


def test_copies_one_long_conversation_and_long_end_lists(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 64)
    rows = [(c, t, "user", f"same {t}") for c in range(600) for t in range(3)]  # one sequence, or a prefix of it
    rows += [(701, t, "user", f"turn {t % 7}") for t in range(900)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


def test_odd_rows_and_columns(spark):
    rows = [(None, 1, "user", "x"), (5, 3, "user", "b"), (5, None, "user", "a"), (5, 1, None, None), (5, 4, "", "x" * 300_000),
            (6, 0, "user", "a"), (6, 0, "user", "a"), (6, 2, "user", "c"), (14, 1, "user", "only")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "d", "f1", "t1", "bytes", "weight", "leaf", "_part", "depth"):
        df = df.withColumn(name, F.col("text"))
    assert got(df) == plain(rows)
    assert got(df.where("false")) == []


def test_turns_of_one_number_have_one_order(spark):
    rows = [(5, 1, "user", x) for x in "abcdefgh"] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.repartition(2)) == got(df.orderBy(F.desc("text")).repartition(7))
    assert max(r[1] for r in got(df)) == 16


def test_running_values_over_split_keys(spark):
    rows = [(1, i, 1 << (i % 40)) for i in range(500)] + [(2, 1, 5), (3, 7, 6)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(6)
    out = P.running(df, "k", ["o"], n=(F.sum, F.lit(1).cast("long")), x=(F.bit_xor, F.col("v"))).collect()
    xor, want = 0, {}
    for k, o, v in rows:
        xor = v if (k, o) in ((1, 0), (2, 1), (3, 7)) else xor ^ v
        want[k, o] = ((o + 1 if k == 1 else 1), xor)
    assert {(r["k"], r["o"]): (r["n"], r["x"]) for r in out} == want
