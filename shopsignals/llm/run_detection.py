"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and a length of
at least max(LEAST, EXPONENT * q) that no neighbouring word extends. A square
of root d (words i .. i+d equal to i+d .. i+2d) is branching where the word
after it breaks the period. Every run ends in one branching square of its
period; all its other squares are that one rotated to the left.

The texts of a batch make one suffix array; symbols are salted by text, so that
nothing matches across texts. Prefix doubling sorts the suffixes and leaves the
ranks of all prefixes of 1, 2, 4 .. words, from which the common prefix of any
two suffixes, and the left rotations of a square, are read by halving steps. An
LCP interval [l, r] of depth d is a range of the array, found from the nearest
smaller LCP on both sides; there are no tree nodes. The suffixes of all its
child ranges but the largest are tested: i and i+d (or i-d) begin a square if
ISA[i+d] (or ISA[i-d]) lies in [l, r] (n log n tests in all). The first word of
a run shares at least max(LEAST, EXPONENT * q) - q words with the one a period
on, so texts without so long a common prefix are left out after the LCP.

Each text is one row, worked on whole within its batch; nothing is exchanged.

Results in cases of doubt: a null text is empty; a text without words has no
run and the digests of nothing; a row without doc_id is never rewritten by
``rewritten``; equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.llm.kernels import M2, M3, U, batch, groups, mix, text_buffer, word_ids
from shopsignals.llm.simhash_vptree import spaced
from shopsignals.llm.tables import ship

LEAST, EXPONENT = 6, 4


def suffix_ranks(symbols: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all texts, and for k = 0, 1 .. the rank of the 2**k
    words from each position (with -1 past the end); the last ranks are the
    inverse of the array. ``stop``: the end of each position's text."""
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    s = symbols[sa]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while not new.all():
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = np.flatnonzero(~alone)
        i = sa[at]
        second = np.where(i + step < stop[i], rank[np.minimum(i + step, n)], -1)
        key = rank[i] * (n + 1) + second + 1
        o = np.argsort(key, kind="stable")
        sa[at], key = i[o], key[o]
        new[at[1:]] = new[at[1:]] | (key[1:] != key[:-1])
        rank = rank.copy()
        rank[sa[at]] = at[np.maximum.accumulate(np.where(new[at], np.arange(len(at)), 0))]
        levels.append(rank)
        step *= 2
    return sa, levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes a and b share, from the longest step down."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        n += (levels[k][a + n] == levels[k][b + n]).astype(np.int64) << k
    return n


def smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest index before and after each position with a smaller value (0 and
    len(lcp) - 1 hold a value below all others), by halving steps over minima."""
    n = len(lcp)
    least = [lcp]
    while 1 << len(least) < n:
        w = 1 << (len(least) - 1)
        m = least[-1]
        least.append(np.minimum(m[:-w], m[w:]) if len(m) > w else m[:0])
        if not len(least[-1]) or (least[-1] <= 0).all():
            break
    before, after = np.arange(n) - 1, np.arange(n) + 1
    for k in range(len(least) - 1, -1, -1):
        m, w = least[k], 1 << k
        low = before - w + 1
        ok = low >= 0
        ok[ok] = m[low[ok]] >= lcp[ok]
        before[ok] -= w
        ok = after + w <= n
        ok[ok] = m[after[ok]] >= lcp[ok]
        after[ok] += w
    return before, after


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Child ranges of all LCP intervals of depth >= 1 without the largest child
    of each: (first, last, parent's first, parent's last) in the array; the depth
    is the least LCP inside the parent. ``lcp[p]`` is of the suffixes p-1 and p."""
    padded = np.append(lcp, -1)
    padded[0] = -1
    before, after = smaller(padded)
    p = np.flatnonzero(padded > 0)
    l, r = before[p], after[p] - 1
    o = np.lexsort((p, padded[p], l))  # the boundaries of one interval, in order
    p, l, r = p[o], l[o], r[o]
    first = np.ones(len(p), bool)
    first[1:] = (l[1:] != l[:-1]) | (padded[p[1:]] != padded[p[:-1]])
    last = np.append(first[1:], True)
    begin = np.concatenate((l[first], p))
    end = np.concatenate((p[first] - 1, np.where(last, r, np.append(p[1:], 0) - 1)))
    of = np.concatenate((np.arange(first.sum()), np.cumsum(first) - 1))
    o = np.lexsort((begin - end, of))  # the largest child of each interval first
    small = np.ones(len(o), bool)
    small[np.flatnonzero(np.concatenate(([True], of[o][1:] != of[o][:-1])))] = False
    o = o[small]
    return begin[o], end[o], l[first][of[o]], r[first][of[o]]


def branching_squares(sa, lcp, levels, start, stop) -> tuple[np.ndarray, np.ndarray]:
    """(position, root length) of all branching squares among the suffixes
    ``sa``, which are those of whole texts."""
    place = np.full(len(levels[0]), -1, np.int64)
    place[sa] = np.arange(len(sa))
    begin, end, l, r = intervals(lcp)
    size = end - begin + 1
    at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    l, r = np.repeat(l, size), np.repeat(r, size)
    i = sa[at]
    depth = common_prefix(levels, sa[l], sa[r])
    ahead, back = i + depth, i - depth
    ok = ahead < stop[i]
    ok[ok] = (place[ahead[ok]] >= l[ok]) & (place[ahead[ok]] <= r[ok])
    too = back >= start[i]
    too[too] = (place[back[too]] >= l[too]) & (place[back[too]] <= r[too])
    s, d = np.concatenate((i[ok], back[too])), np.concatenate((depth[ok], depth[too]))
    e = s + 2 * d
    breaks = e == stop[s]
    more = ~breaks
    breaks[more] = levels[0][s[more] + d[more]] != levels[0][e[more]]
    s, d = s[breaks], d[breaks]
    o = np.lexsort((d, s))
    s, d = s[o], d[o]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]


def runs(ids: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, length, period) of all runs of the texts ``row`` of word
    identifiers ``ids``, in order of position, then period."""
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, none
    edge = np.searchsorted(row, np.arange(rows + 1))
    start, stop = edge[row], edge[row + 1]
    sa, levels = suffix_ranks(mix(ids, row.astype(U) * M3 + M2), stop)
    lcp = np.zeros(len(sa), np.int64)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[near] = common_prefix(levels, sa[near - 1], sa[near])
    able = np.zeros(rows, bool)
    able[row[sa[lcp >= min(max(LEAST, EXPONENT * q) - q for q in range(1, LEAST))]]] = True
    rest = able[row[sa]]
    if not rest.any():
        return none, none, none
    s, d = branching_squares(sa[rest], lcp[rest], levels, start, stop)
    first = s.copy()  # rotate to the left while the word before equals the one a period on
    for k in range(len(levels) - 1, -1, -1):
        ok = first - (1 << k) >= start[s]
        x = first[ok] - (1 << k)
        ok[ok] = levels[k][x] == levels[k][x + d[ok]]
        first[ok] -= 1 << k
    length = s + 2 * d - first
    long = length >= np.maximum(LEAST, EXPONENT * d)
    first, length, d = first[long], length[long], d[long]
    o = np.lexsort((d, length, first))  # of one stretch, the smallest period
    first, length, d = first[o], length[o], d[o]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (length[1:] != length[:-1])
    first, length, d = first[new], length[new], d[new]
    o = np.lexsort((d, first))
    return first[o], length[o], d[o]


def rewritten(doc_id: int, n: int) -> np.ndarray | None:
    """The original word that each of a text's n words becomes: with h the CRC-32
    of the id's decimal form, where h % 10 = 0 the words from a = (h // 10) % n on
    repeat the first 1 + (n - a) // (3 + (h // 10) % 8) of them."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return i


def _digests(rewrite: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()),
                        ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
                        ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def one(text, begin, end, source, found):
        """Digests and strongest run of one text: ``source`` the word at each
        place, or None where all stand in order; ``found`` its runs."""
        n = len(begin)
        listed = hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        if not found and source is None:
            kept = hashlib.sha256(text[begin[0]:end[-1]] if n else b"")
        else:
            gone = np.zeros(n + 1, np.int64)
            for s, length, q in found:
                gone[s + q] += 1
                gone[s + length] -= 1
            words = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            words = words if source is None else source[words]
            kept = hashlib.sha256()
            for i in range(0, len(words), 4096):
                w = words[i:i + 4096]
                kept.update(b" " * (i > 0) + b" ".join([text[a:b] for a, b in zip(begin[w].tolist(), end[w].tolist())]))
        return (n, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, listed, kept.hexdigest())

    def apply(batches):
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            doc = b.column("doc_id")
            for i, j in groups(off):
                out, begin, end, row = spaced(raw, off[i:j + 1])
                text, rows = out.tobytes(), j - i
                edge = np.searchsorted(row, np.arange(rows + 1))
                place, moved = np.arange(len(row)), {}
                for k, d in enumerate(doc.slice(i, rows).to_pylist()):
                    m = rewritten(d, int(edge[k + 1] - edge[k])) if rewrite and d is not None else None
                    if m is not None:
                        moved[k] = m
                        place[edge[k]:edge[k + 1]] = edge[k] + m
                first, length, period = runs(word_ids(out, begin, end)[place], row, rows)
                of = np.searchsorted(row[first] if len(first) else first, np.arange(rows + 1))
                res = []
                for k in range(rows):
                    x, e = slice(of[k], of[k + 1]), slice(edge[k], edge[k + 1])
                    found = list(zip((first[x] - edge[k]).tolist(), length[x].tolist(), period[x].tolist()))
                    res.append(one(text, begin[e], end[e], moved.get(k), found))
                cols = [pa.array(c, f.type) for c, f in zip(zip(*res), list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([doc.slice(i, rows), *cols], schema=schema)
    return apply


def run_digests(documents: DataFrame, rewrite: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_runs, the run of greatest length by
    period (start, length, period, exponent_milli; ties: smallest start, then
    period), and SHA-256 digests of all runs and of the words left when all but
    the first period of every run is dropped. ``rewrite`` plants runs by id
    (``rewritten``) in a tenth of the texts before."""
    ship(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_digests(rewrite), "doc_id long, n_words long, n_runs long, start long, length long, period long, "
                            "exponent_milli long, runs_sha256 string, collapsed_sha256 string")
