"""Byte and word repeats against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from shopsignals.llm.bucket_refinement import remove_repeated_bytes
from shopsignals.llm.rlz_dedup import kept_words, remove_duplicate_spans


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 7)))
    passage = [" ".join(word() for _ in range(k)) for k in (20, 40, 60, 90)]
    out = []
    for i in range(n):
        t = " ".join(word() for _ in range(rnd.randint(0, 150)))
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passage)
            cut = rnd.randint(0, len(p) // 3)
            t += rnd.choice([" ", "\n", "\t "]) + p[cut:] + " " + word()
        if out and rnd.random() < 0.2:
            t = rnd.choice(out)
        elif out and rnd.random() < 0.2:
            t = rnd.choice(out)
            k = rnd.randint(0, len(t))
            t = t[:k] + word() + t[k:]
        out.append(t)
    out += ["spam " * 300, "ab" * 400, "", None, "x", "zq" * 200 + passage[3], passage[2] + "\n" + passage[2]]
    return list(enumerate(out))


def bytes_brute(rows, w=100):
    seen, res = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - w + 1):
            k = b[p:p + w]
            if k in seen:
                gone[p:p + w] = b"\1" * w
            seen.add(k)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        res.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return res


def words_brute(rows, w=35):
    at = defaultdict(int)
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for x in split.values():
        for p in range(len(x) - w + 1):
            at[tuple(x[p:p + w])] += 1
    res = []
    for i, x in sorted(split.items()):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - w + 1):
            if at[tuple(x[p:p + w])] > 1:
                gone[p:p + w] = True
        kept = " ".join(y for y, g in zip(x, gone) if not g)
        res.append((i, len(x), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return res


def test_bytes_match_brute_force(docs):
    rows = corpus()
    assert sorted(map(tuple, remove_repeated_bytes(docs(rows, extra=True)).collect())) == bytes_brute(rows)


def test_words_match_brute_force(docs):
    rows = corpus(5)
    assert sorted(map(tuple, kept_words(docs(rows, extra=True)).collect())) == words_brute(rows)


def test_small_blocks_and_batches_change_nothing(docs, monkeypatch):
    """Scans carry their state over batch ends; local settling over blocks."""
    from shopsignals.llm import bucket_refinement as B, repeats as R

    rows = corpus(7, 40)

    def run(width, phrases, locate, windows, keep):
        """The two exchanges in plain numpy, one row a batch."""
        import pyarrow as pa
        texts = [(i, t) for i, t in rows if t is not None]

        def scan(blocks, opens):
            rb = [b for p in blocks for b in R.settled(iter([p]), keep)]
            t = pa.Table.from_batches(rb, R.ROWS).sort_by([(c, "ascending") for c in ("open", "a", "h", "doc", "s")])
            return pa.Table.from_batches(list(R.compare(keep, opens)(t.to_batches(max_chunksize=1))), R.SPANS).to_pylist()

        def one():
            for i, t in texts:
                raw = np.frombuffer(t.encode(), np.uint8)
                yield from phrases(raw, np.array([0, len(raw)]), np.array([i]))
        first = scan(one(), True)
        opened = defaultdict(list)
        for r in first:
            if r["open"]:
                opened[r["doc"]].append({"s": r["s"], "n": r["n"]})
        kind = pa.list_(pa.struct([("s", pa.int64()), ("n", pa.int64())]))

        def single():
            for i, t in texts:
                raw = np.frombuffer(t.encode(), np.uint8)
                spans = pa.array([sorted(opened[i], key=lambda x: x["s"])], kind)
                for row, s, n, lo, hi in locate(raw, np.array([0, len(raw)]), spans):
                    for k in range(len(lo)):
                        yield windows(raw, np.array([lo[k], hi[k]]), np.array([i]), s[k:k + 1], n[k:k + 1])
        second = scan(single(), False)
        return {(r["doc"], p) for r in first + second if not r["open"] for p in range(r["s"], r["s"] + r["n"])}

    monkeypatch.setattr(B, "SEGMENT", 150)
    got = run(100, B._pointers(100), B._located(100), B._suffixes(100), True)
    seen, want = set(), set()
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                want.add((i, p))
            seen.add(b[p:p + 100])
    assert got == want


def test_repeated_and_null_ids(docs):
    t = " ".join(f"w{i}" for i in range(80))
    got = {(r["doc_id"], r["n_removed"]) for r in remove_repeated_bytes(docs([(1, t), (1, t), (None, t), (2, t)])).collect()}
    assert got == {(1, 0), (None, 0), (2, len(t))}
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in kept_words(docs([(1, t), (1, t), (None, t)])).collect())
    assert got == [(0, 0), (1, 0), (1, 0)]


def test_empty_table(docs):
    assert remove_repeated_bytes(docs([])).collect() == []
    assert kept_words(docs([])).collect() == []


def test_rewrite_keeps_columns(docs):
    p = " ".join(f"p{i}" for i in range(50))
    rows = [(1, "a b\n" + p, "en", "s", 9), (2, p + " c", "en", "s", 9), (3, "left  as\nit is", "en", None, 14), (4, None, None, None, None)]
    out = {r["doc_id"]: r.asDict() for r in remove_duplicate_spans(docs(rows, extra=True)).collect()}
    assert [out[i]["text"] for i in (1, 2, 3, 4)] == ["a b", "c", "left  as\nit is", None]
    assert [out[i]["n_chars"] for i in (1, 2, 3, 4)] == [3, 1, 14, None]
    assert out[1]["spans"] == "1"


def test_periodic_runs_found_nowhere_else(docs):
    """A text of one period keeps one smallest gram: its windows lie in one phrase."""
    def around(i, middle):
        return " ".join(f"l{i}x{k}" for k in range(40)) + middle + " ".join(f"r{i}x{k}" for k in range(40))

    units = ["-", "~", "*", "=+", "0,1,", "abcdefghijk", "".join(chr(48 + k) for k in range(69)), "#", "%"]
    sizes = [101, 150, 99 + 2 * 93, 102, 192, 130, 170, 192, 400]
    rows = list(enumerate(around(i, (u * size)[:size]) for i, (u, size) in enumerate(zip(units, sizes))))
    want = bytes_brute(rows)
    assert [r[2] > 0 for r in want] == [True] * len(rows)
    assert sorted(map(tuple, remove_repeated_bytes(docs(rows)).collect())) == want

    period = lambda i, p, size: " " + " ".join(f"w{i}p{k % p}" for k in range(size)) + " "
    sizes = [(1, 36), (2, 40), (3, 66), (5, 50), (28, 63), (28, 66), (1, 34 + 64), (2, 66)]
    rows = list(enumerate(around(i, period(i, p, size)) for i, (p, size) in enumerate(sizes)))
    want = words_brute(rows)
    assert all(r[2] == size for r, (p, size) in zip(want, sizes))
    assert sorted(map(tuple, kept_words(docs(rows)).collect())) == want
