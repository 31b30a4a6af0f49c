"""The pipeline's stages against plain versions of their decisions."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from paths import SF
from test_forest import brute
from test_packing import ids_of

from shopsignals.llm import mil_quality
from shopsignals.llm.tables import read, store


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    given = {r["doc_id"]: r for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in mil_quality.score(docs, mil_quality.train(docs, read(spark, SF, "labels"))).collect()}
    steps = []
    for name, stage in P.STAGES:
        docs = store(stage(spark, docs, SF), "test")
        steps.append((docs, docs.collect()))
    assert all(d.columns == columns for d, _ in steps[:-1])

    kept = [r for r in given.values() if scores[r["doc_id"]] == 1]
    assert sorted(r["doc_id"] for r in steps[0][1]) == sorted(r["doc_id"] for r in kept)

    group, _ = brute([(r["doc_id"], r["text"]) for r in kept])
    assert sorted(r["doc_id"] for r in steps[1][1]) == sorted(i for i, g in group.items() if i == g)

    split = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for r in steps[1][1]}
    often = Counter(tuple(w[i:i + 35]) for w in split.values() for i in range(len(w) - 34))
    for r in steps[2][1]:
        w = split[r["doc_id"]]
        hit = {p for i in range(len(w) - 34) if often[tuple(w[i:i + 35])] > 1 for p in range(i, i + 35)}
        want = " ".join(x for i, x in enumerate(w) if i not in hit) if hit else given[r["doc_id"]]["text"]
        assert r["text"] == want and r["n_chars"] == len(want)

    size = defaultdict(int)
    for r in steps[2][1]:
        size[r["source"]] += len(r["text"].split())
    copies = Counter(r["doc_id"] for r in steps[3][1])
    assert max(copies.values()) <= 2 and set(copies) <= set(split)
    taken = sum(len(r["text"].split()) for r in steps[3][1])
    assert abs(taken - 1.5 * sum(size.values())) < 0.05 * sum(size.values())

    pieces = Counter()
    text = {r["doc_id"]: r["text"] for r in steps[3][1]}
    for r in steps[4][1]:
        pieces[r["doc_id"]] += r["length"]
    for i in list(text)[:60]:
        assert pieces[i] == copies[i] * len(ids_of(text[i]))
    assert set(pieces) == set(text)


def test_odd_tables(spark, docs, tmp_path):
    import pandas as pd

    pd.DataFrame({"doc_id": pd.Series([1, 2], dtype="int64"), "quality": [1, 0], "toxic": [0, 0]}).to_parquet(tmp_path / "labels.parquet")
    for rows in ([], [(1, None), (2, ""), (2, ""), (None, "a b c d e f"), (3, "a b c d e f", "en", None, 11), (4, "a b c d e f", None, "s", 1)]):
        d = docs(rows, extra=True)
        for _, stage in P.STAGES:
            d = store(stage(spark, d, str(tmp_path)), "odd")
        assert d.count() >= 0
