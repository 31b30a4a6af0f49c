"""Targets against resharing by hand; the mix against its constraints."""

import random
import re

import pytest

from shopsignals.llm.entropy_mixing import mix, resample, taken_words


def reshare(size):
    """Resharing as stated, source by source and round by round."""
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    limit = {s: 2.0 * size[s] for s in order}
    target, free, left = {}, list(order), 1.5 * sum(size.values())
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > limit[s]]
        if not above:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            target[s] = limit[s]
        left -= sum(limit[s] for s in above)
        free = [s for s in free if s not in above]
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(docs, seed):
    rnd = random.Random(seed)
    names = ["a", "B", "é", "z", "", None, "\U0001F600", "hot"]
    rows = []
    for i in range(900):
        s = "hot" if rnd.random() < 0.4 else rnd.choice(names)
        t = None if rnd.random() < 0.02 else " ".join("w" * rnd.randint(1, 5) for _ in range(min(int(rnd.paretovariate(1.1) * 10), 900)))
        rows.append((i, t, "en", s, 0))
    rows += [(1000 + i, "same five words again   x", "en", "z", 0) for i in range(50)]
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    per = {}
    for r in rows:
        per[r[3]] = per.get(r[3], 0) + size[r[0]]
    want = reshare(per)
    out = taken_words(docs(rows, extra=False)).collect()
    assert len(out) == len(rows)
    source, taken = {r[0]: r[3] for r in rows}, {}
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in per:
        assert abs(taken[s] - want[s]) <= max(size[r[0]] for r in rows if r[3] == s) + 1e-6 * want[s] + 1
    again = taken_words(docs(rows).repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_resample_keeps_columns_and_counts(docs):
    rows = [(i, "a b c " * (i % 7), "en", "s" + str(i % 3), i) for i in range(60)] + [(None, None, None, None, None)]
    d = docs(rows, extra=True)
    copies = {r["doc_id"]: r["copies"] for r in mix(d).collect()}
    out = resample(d)
    assert out.columns == d.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert r["text"] == "a b c " * (r["doc_id"] % 7)
    assert got == {k: v for k, v in copies.items() if v}


def test_empty_and_wordless(docs):
    assert taken_words(docs([])).collect() == []
    out = taken_words(docs([(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0), (0, 0.0, 0)]
