"""SimHash fingerprints and components against plain versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from shopsignals.llm import simhash_vptree as S
from shopsignals.llm.kernels import U
from shopsignals.llm.queries import QUERIES
from tests.conftest import SF_ORACLE


def plain_print(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_roots(x, bits):
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= bits):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def plain(rows, bits=3):
    prints = {(i, t): plain_print(t) for i, t in rows}
    known = sorted({(i, p) for (i, _), p in prints.items() if i is not None})
    x = np.array([p for _, p in known], U)
    by_id = defaultdict(list)
    for k, (i, _) in enumerate(known):
        by_id[i].append(k)
    roots = plain_roots(x, bits)
    changed = True
    while changed:  # rows of one id are one document
        changed = False
        for ks in by_id.values():
            rs = {roots[k] for k in ks}
            if len(rs) > 1:
                roots = [min(rs) if r in rs else r for r in roots]
                changed = True
    least, comp = {}, {}
    for (i, p), r in zip(known, roots):
        least[r] = min(i, least.get(r, i))
    for (i, p), r in zip(known, roots):
        comp[p] = least[r]
    return sorted(((i, f"{prints[i, t]:016x}", comp.get(prints[i, t])) for i, t in rows), key=str)


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeFGé") for _ in range(rnd.randint(1, 6)))
    out = []
    for i in range(260):
        if out and rnd.random() < .5:
            w = rnd.choice(out)[1].split(" ")
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = word()
            t = rnd.choice([" ", "\n\t"]).join(w)
            t = t.upper() if rnd.random() < .2 and t.isascii() else t
        else:
            t = " ".join(word() for _ in range(rnd.choice([1, 2, 3, 60, 200])))
        out.append((i, t))
    return out + [(900, ""), (901, None), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "x " * 100_000), (None, "one two"), (None, "lonely text"),
                  (3, out[3][1]), (5, out[90][1]), (5, "quite different"), (-4, out[7][1])]


def test_documents_match_the_plain_version(docs):
    rows = corpus()
    got = sorted(map(tuple, S.components_by_fingerprint(docs(rows, extra=True)).collect()), key=str)
    assert got == plain(rows)
    assert len({g[2] for g in got}) < len(got) - 20
    assert S.components_by_fingerprint(docs(rows).where("false")).count() == 0


def fingerprints(n, seed=2):
    """Random ones with neighbours at one to five bits, and one dense ball."""
    rnd = np.random.default_rng(seed)
    x = rnd.integers(0, 1 << 63, n, dtype=U)
    near = x[:n // 2].copy()
    for k in range(5):
        near = np.where(rnd.random(len(near)) < .6, near ^ (U(1) << rnd.integers(0, 64, len(near)).astype(U)), near)
    ball = x[0] ^ np.bitwise_or.reduce(U(1) << rnd.integers(0, 14, (n // 4, 4)).astype(U), axis=1)
    return np.unique(np.concatenate((x, near, ball)))


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_tree_finds_all_links(bits, monkeypatch):
    x = fingerprints(3000)
    monkeypatch.setattr(S, "LEAF", 40)
    monkeypatch.setattr(S, "PAIRS", 500)
    assert S.linked(x, bits).tolist() == plain_roots(x, bits)


def test_every_pair_is_whole_in_a_shard():
    x = fingerprints(2500)
    nodes = S.fit_tree(x[::3], 24, 3)
    assert len(nodes) > 12
    at, shard = S.deal(x, nodes, 3)
    held = np.zeros((len(x), shard.max() + 1), bool)
    held[at, shard] = True
    assert held.any(1).all()
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3):
            assert (held[i] & held[j]).any()


def test_given_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARDS_ROOT", 2)  # several shards on a small table
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op13_simhash_vptree"](spark, SF_ORACLE).collect()), key=str)
    assert got == plain(rows)
