"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shopsignals.llm import run_detection as R
from shopsignals.llm.kernels import U
from shopsignals.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            e = k
            while e < n - q and w[e] == w[e + q]:
                e += 1
            if e > k and e - k + q >= max(6, 4 * q):
                out.setdefault((k, e - k + q), q)
            k = max(e, k + 1)
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda x: (x[0], x[2]))


def plain(doc_id, text, rewrite):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if rewrite and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, n, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=10)), max_size=5))
def test_runs_of_several_texts(parts):
    texts = [a * k + b + a for a, k, b in parts]
    ids = np.array([x for t in texts for x in t], U)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first, length, period = R.runs(ids, row, len(texts))
    got = [[] for _ in texts]
    for s, n, q in zip(first.tolist(), length.tolist(), period.tolist()):
        got[row[s]].append((s - int(np.searchsorted(row, row[s])), n, q))
    assert got == [plain_runs(t) for t in texts]


def corpus():
    rnd = random.Random(4)
    out = []
    for i in range(300):
        w = [rnd.choice("abcdé") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 2)):
            unit = [rnd.choice("xyz") for _ in range(rnd.randint(1, 9))]
            at = rnd.randint(0, len(w))
            w[at:at] = (unit * 8)[:rnd.randint(4, 8) * len(unit) + rnd.randint(0, len(unit) - 1)]
        out.append((i, rnd.choice([" ", "\n", " \t"]).join(w)))
    out += [(1000, ""), (1001, None), (1002, " \n "), (1003, "buy now " * 1000), (1004, "a " * 5), (1005, "a " * 6), (1006, "a b " * 4),
            (1007, "a b c " * 4), (None, "z " * 9), (7, "a " * 30), (7, "a " * 30), (-3, "q r " * 11)]
    return out


def test_documents_match_the_plain_scan(docs):
    rows = corpus()
    for rewrite in (False, True):
        got = sorted(map(tuple, R.run_digests(docs(rows, extra=True), rewrite).collect()), key=str)
        assert got == sorted((plain(i, t, rewrite) for i, t in rows), key=str)
    assert R.run_digests(docs(rows).where("false")).count() == 0


def test_a_very_long_text(docs):
    r = R.run_digests(docs([(1, "buy now " * 200_000 + "end")])).first()
    assert tuple(r)[:7] == (1, 400_001, 1, 0, 400_000, 2, 200_000_000)
    assert r["collapsed_sha256"] == hashlib.sha256(b"buy now end").hexdigest()


def test_given_documents(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op11_run_detection"](spark, SF_SMALL).collect()))
    short = {r["doc_id"] for r in rows if len(r["text"] or "") < 20_000}
    assert [g for g in got if g[0] in short] == sorted(plain(r["doc_id"], r["text"], True) for r in rows if r["doc_id"] in short)
    assert len(got) == len(rows) and sum(g[2] > 0 for g in got) > 5
