"""Groups against brute force over all pairs."""

import random
import re

import pytest

from shopsignals.llm import minhash_forest as M


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    """Smallest id of each document's component over all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    links = set()
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links.add((i, j))
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}, links


def corpus(seed, families=25, copies=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 8)))
    out = []
    for f in range(families):
        base = [word() for _ in range(rnd.choice([30, 80, 200, 600]))]
        for c in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, len(w) // 40, len(w) // 20])):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w))
    rnd.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(docs, seed):
    rows = corpus(seed) + [(900, ""), (901, None), (902, "a b"), (903, "a b"), (904, "a  b\n"), (905, "b a"), (906, "one"), (907, "x " * 400),
                           (908, "x " * 300), (None, "a b"), (902, "a b")]
    out = M.classes(docs(rows, extra=True)).collect()
    assert len(out) == len(rows)
    want, links = brute(rows)
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert {i: r["class_id"] for i, r in got.items()} == want
    sets = {i: shingles(t) for i, t in rows if i is not None}
    for i, r in got.items():
        assert sets[r["text_id"]] == sets[i]
        other = any(sets[a] != sets[b] for a, b in links if i in (a, b))
        assert (r["n_links"] > 0) == other


def test_template_crowds_part_in_the_second_forest(docs, monkeypatch):
    """Of texts that share a template and are not similar, few come to blocks."""
    rows = [(i, " ".join([f"t{k}" for k in range(100)] + [f"o{i}x{k}" for k in range(60)])) for i in range(300)]
    stored, store = {}, M.store

    def spy(df, name):
        stored[name] = store(df, name)
        return stored[name]
    monkeypatch.setattr(M, "store", spy)
    assert {r["n_links"] for r in M.classes(docs(rows)).collect()} == {0}
    size = lambda name: sum(r["many"] for r in stored[name].where(f"many > {M.LISTED}").collect())
    assert size("prefixes") > 10_000 and size("deep-prefixes") < size("prefixes") / 3


def test_one_large_group(docs):
    """Hundreds of near copies: one group, pairs in proportion to its size."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(150)]
    rows = []
    for i in range(1, 601):
        w = list(base)
        w[rnd.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(w)))
    members, links, roots = M.near_duplicates(docs(rows))
    assert {r["root"] for r in roots.collect()} == {1} and roots.count() == 600
    assert links.count() < 2400


def test_crowded_prefixes_are_split(docs, monkeypatch):
    monkeypatch.setattr(M, "CROWD", 7)
    rows = corpus(3, 6, 40)
    assert {r["doc_id"]: r["class_id"] for r in M.classes(docs(rows)).collect()} == brute(rows)[0]


def test_components_of_paths(spark):
    rnd = random.Random(1)
    e = [(i, i + 1) for i in range(0, 60) if i % 20] + [(100, 5), (7, 7)]
    rnd.shuffle(e)
    got = {r["node"]: r["root"] for r in M.components(spark.createDataFrame(e, "a long, b long")).collect()}
    want = {i: (1 if i <= 20 else 21 if i <= 40 else 41) for i in range(1, 61)} | {100: 1}
    assert got == want


def test_keep_one_and_empty(docs):
    rows = [(5, "p q r s t u v w"), (3, "p q r s t u v  w"), (9, "other words are in this"), (None, "p q r s t u v w"), (7, None)]
    d = docs(rows, extra=True)
    out = M.keep_one(d)
    assert out.columns == d.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 3, 7, 9]
    assert M.classes(docs([])).collect() == []


def test_depth_reaches_recall():
    assert M.prefix_depth(0.8, 0.999) == 4 and M.prefix_depth(0.8, 0.99999) < 4 and M.prefix_depth(0.99, 0.9) == M.DEPTH


def test_second_forest_keeps_recall():
    d = M.prefix_depth(0.8, 0.9999)
    deep, tries = M.deeper(0.8, d)
    assert d < deep <= M.DEPTH and tries <= M.DEEP
    assert (1 - 0.8 ** deep) ** tries <= (1 - 0.8 ** d) ** M.TREES
    assert M.deeper(0.2, M.prefix_depth(0.2, 0.9)) is None and M.deeper(0.8, M.DEPTH) is None


def test_one_id_with_two_texts_joins_nothing_unrelated(docs):
    a, b = ([f"{x}{k}" for k in range(60)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join(a)), (7, " ".join(b)), (8, " ".join(a + ["more"])), (9, " ".join(["more"] + b))]
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs(rows)).collect()}
    assert got[6] == got[8] != got[7] == got[9]
    assert got[5] in (got[6], got[7])


def template_corpus(seed, n=560, pairs=30):
    """Texts that share three quarters of a pair's union, and pairs above 0.8."""
    rnd = random.Random(seed)
    template = [f"t{k}" for k in range(150)]
    rows = []
    for i in range(n):
        own = [f"o{i}x{k}" for k in range(42)]
        rows.append(template + own)
        if i < pairs:  # a second text: most of the own words too, others at the end
            rows.append(template + own[:22] + [f"p{i}x{k}" for k in range(20)])
    rnd.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows, 1)]


def degrees(links):
    out = {}
    for x in (y for p in links for y in p):
        out[x] = out.get(x, 0) + 1
    return out


def test_template_shared_by_many_texts(docs):
    rows = template_corpus(4)
    want, links = brute(rows)
    assert len(links) == 30
    got = {r["doc_id"]: r for r in M.classes(docs(rows)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items() if r["n_links"]} == degrees(links)


@pytest.mark.parametrize("crowd", [7, 512])
def test_numbers_of_links_match_brute_force(docs, monkeypatch, crowd):
    monkeypatch.setattr(M, "CROWD", crowd)
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = corpus(6, 6, 30)
    for i in range(1000, 1070):
        w = list(base)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(150)] = f"v{i}x{rnd.randrange(9)}"
        rows.append((i, " ".join(w)))
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingles(t)), i)
    rows = [(i, t) for i, t in rows if sets[frozenset(shingles(t))] == i]  # no equal texts
    links = brute(rows)[1]
    assert len(links) > 500
    assert {r["doc_id"]: r["n_links"] for r in M.classes(docs(rows)).collect() if r["n_links"]} == degrees(links)
