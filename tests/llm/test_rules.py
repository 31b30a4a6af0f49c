"""Counts against brute force; sketches against exact quartiles; verdicts."""

import math
import random
import re
from collections import Counter

import pytest

from shopsignals.llm.adaptive_rules import GROWTH, MEASURES, counts, filter_documents, quartiles, sketch, thresholds, verdicts


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(win)
    hit = {p for i, g in enumerate(win) if often[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def texts():
    rnd = random.Random(8)
    out = ["", None, " \n ", "a", "é\U0001F600 ü ß x", "a b c d e a b c d e", "x\nx\n x\nx \n\n\n", "a b c d e f " * 30,
           "## ** $$ %% && || <> " * 5, "one two\r\none two\r\n"]
    for _ in range(80):
        w = [rnd.choice("abc") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 60))]
        out.append("".join(x + rnd.choice([" ", " ", "\n", "\t", " # "]) for x in w))
    return out


def test_counts_match_brute_force(docs):
    rows = list(enumerate(texts()))
    got = sorted(tuple(r)[:6] for r in counts(docs([(i, t, "en", "s", 0) for i, t in rows], extra=True))
                 .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == [(i, *brute(t)) for i, t in rows]
    base = {r["doc_id"]: r for r in verdicts(docs([(i, t, None, None, 0) for i, t in rows])).collect()}
    for i, t in rows:
        n, *_, rep = brute(t)
        assert base[i]["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (base[i]["kept"] and base[i]["base_failed"])


def prose(rnd, n=120):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_sketch_quartiles_and_merging(docs):
    rnd = random.Random(9)
    rows = [(i, " ".join("x" * rnd.randint(1, 30) for _ in range(20)), rnd.choice(["en", None]), rnd.choice(["a", "b", None]), 0) for i in range(400)]
    s = sketch(counts(docs(rows)))
    for keys in (["lang", "source"], ["lang"], []):
        for r in quartiles(s, keys).where("measure = 'word_length'").collect():
            own = sorted(brute(t)[1] / 20 for _, t, *k in rows if all(dict(zip(("lang", "source"), k))[c] == r[c] for c in keys))
            assert r["n"] == len(own)
            for q, c in ((0.25, "lower"), (0.75, "upper")):
                assert r[c] == pytest.approx(own[-(-int(len(own) * q * 4) // 4) - 1 if (len(own) * q) % 1 == 0 else int(len(own) * q)], rel=GROWTH - 1)


def test_adapts_to_its_group(docs):
    rnd = random.Random(10)
    rows = [(i, prose(rnd), "en", "plain", 0) for i in range(300)]
    rows += [(1000 + i, re.sub(r" ", " | ", prose(rnd)), "en", "tables", 0) for i in range(300)]
    rows += [(2000, re.sub(r" ", " | ", prose(rnd)), "en", "plain", 0), (2001, prose(rnd), "en", "plain", 0),
             (2002, "x" * 40 + (" " + "y" * 40) * 30, "en", "small", 0), (2003, prose(rnd), "xx", None, 0),
             (2004, "\n".join(prose(rnd, 12) for _ in range(3)) + ("\n" + prose(random.Random(1), 4)) * 9, "en", "plain", 0)]
    v = {r["doc_id"]: r["kept"] for r in verdicts(docs(rows)).collect()}
    assert all(v[r[0]] for r in rows if r[0] < 2000)
    assert not v[2000] and v[2001] and not v[2002] and v[2003] and not v[2004]
    d = docs(rows, extra=True)
    out = filter_documents(d)
    assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(k for k, x in v.items() if x)


def plain_kept(rows, prior=50, reach=4.0):
    """Verdicts by exact counts of logarithmic bins, group by group."""
    c = {i: (lang, source, *brute(t), len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])) for i, t, lang, source, _ in rows}
    value = {"symbols": lambda x: x[4] / x[2], "dup_lines": lambda x: x[5] / x[7], "repeats": lambda x: x[6] / x[2], "word_length": lambda x: x[3] / x[2]}

    def quart(vs):
        b = sorted((-10**9 if v <= 0 else math.ceil(math.log(v) / math.log(GROWTH))) for v in vs)
        mid = [0.0 if k == -10**9 else GROWTH ** (k - 0.5) for k in b]
        return [mid[max(0, math.ceil(len(mid) * q) - 1)] for q in (0.25, 0.75)]
    out = {}
    for i, x in c.items():
        n = x[2]
        good = not (n < 10 or 100 * x[6] > 20 * n)
        for m, (_, slack, mean) in MEASURES.items():
            if not n:
                break
            same = lambda k: [value[m](y) for y in c.values() if y[2] and y[:k] == x[:k]]
            own, lang, every = same(2), same(1), same(0)
            w, v = len(own) / (len(own) + prior), len(lang) / (len(lang) + prior)
            lo, hi = (w * a + (1 - w) * (v * b + (1 - v) * e) for a, b, e in zip(quart(own), quart(lang), quart(every)))
            fence = max(hi - lo, slack) * reach * (math.sqrt(1 + 20 / n) if mean else 1)
            good &= value[m](x) <= hi + fence and (not mean or value[m](x) >= lo - fence)
        out[i] = good
    return out


def test_verdicts_match_a_plain_version(docs):
    rnd = random.Random(12)
    rows = []
    for i in range(260):
        t = prose(rnd, rnd.choice([9, 10, 30, 90]))
        t = t.replace(" ", rnd.choice([" ", " ", "\n", " | ", " # "]), rnd.choice([0, 3, 20]))
        t += rnd.choice(["", "", "\nagain and again" * rnd.randint(1, 6)])
        rows.append((i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), 0))
    rows += [(900, None, "en", "a", 0), (901, "", None, None, 0), (902, "é " * 40, "xx", "only", 0)]
    got = {r["doc_id"]: r["kept"] for r in verdicts(docs(rows)).collect()}
    want = plain_kept(rows)
    assert got == want and 0 < sum(want.values()) < len(want) - 20


def test_thresholds_move_continuously_with_a_group(docs):
    """One document more moves a group's thresholds by little, whatever its size."""
    rnd = random.Random(13)
    base = [(i, prose(rnd, 40), "en", "plain", 0) for i in range(200)]
    odd = [(1000 + i, prose(rnd, 40).replace(" ", " | ", 30), "en", "odd", 0) for i in range(120)]
    last = None
    for n in (1, 2, 20, 21, 49, 50, 51, 119, 120):
        t = thresholds(sketch(counts(docs(base + odd[:n])))).where("source = 'odd'").first()
        at = t["symbols_upper"] + t["symbols_fence"]
        if last is not None and n == last[0] + 1:
            assert abs(at - last[1]) < 0.08
        last = (n, at)


def test_empty_table(docs):
    assert verdicts(docs([])).collect() == []
