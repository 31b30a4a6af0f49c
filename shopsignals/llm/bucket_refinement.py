"""Exact removal of repeated byte strings by bucket-pointer refinement.

The suffixes of the corpus start in buckets of short byte grams (eight bytes,
exact). A bucket is refined by the bucket identifiers at later offsets: depth
2d pairs the identifiers at depth d of positions p and p + d, so each pass
reuses the identifiers the pass before has updated (8, 16, 32, 64), and
identifiers at p and p + 36 of depth 64 tell strings of 100 bytes apart. A
suffix array to depth 100 is all that the question needs: suffixes in one
final bucket are equal there, and their order inside it is (doc_id, start).

Only pointers that can meet are sorted: each position hands its suffix to the
smallest 32-gram bucket in its 100 bytes (equal strings hand it to equal
buckets), neighbours with one bucket travel as one pointer, and a bucket is
opened into single suffixes only while it holds different pointers.

Results in cases of doubt: null text is empty; rows without doc_id take no part
and keep all bytes; rows that repeat a doc_id name the same document, so equal
places of it are not earlier than each other, and each such row loses the spans
found for that id; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.llm import repeats
from shopsignals.llm.kernels import U, batch, groups, load8, mix, text_buffer, window_min
from shopsignals.llm.span_lists import flatten, slices

GRAM = 32  # bytes of an initial sorted bucket
SEGMENT = 1 << 21
OUT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                 ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _refine(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers at depth 32 and 64 of every position of ``x``."""
    g8 = load8(x)[:max(len(x) - 7, 0)]
    g16 = mix(g8[:-8], g8[8:], 31)
    g32 = mix(g16[:-16], g16[16:], 29)
    return g32, mix(g32[:-32], g32[32:], 30)


def _pointers(width: int):
    def phrases(raw, off, doc):
        for i, j in groups(off, SEGMENT):
            base = 0
            if j == i + 1:  # a long text goes by segments that overlap by width - 1
                edges = range(int(off[i]), max(int(off[j]) - width + 1, int(off[i]) + 1), SEGMENT)
                parts = [(e, min(e + SEGMENT + width - 1, int(off[j]))) for e in edges]
            else:
                parts = [(int(off[i]), int(off[j]))]
            for lo, hi in parts:
                if hi - lo < width:
                    continue
                base = lo
                x = raw[lo:hi]
                g32, g64 = _refine(x)
                low = window_min(g32, width - GRAM + 1)
                ends = off[i + 1:j + 1] - lo if j > i + 1 else np.array([hi - lo])
                size = np.diff(np.concatenate(([0], ends)))
                good = np.maximum(size - width + 1, 0)
                ok = np.repeat(np.tile([True, False], len(size)),
                               np.ravel(np.column_stack((good, size - good))))[:len(low)]
                s, n = repeats.runs(low, ok, 3 * 64 - width + 1)  # what three identifiers cover
                span = n + width - 1
                h = mix(mix(g64[s], g64[s + (span - 64) // 2]), g64[s + span - 64] ^ span.astype(U))
                if j > i + 1:
                    row = i + np.searchsorted(ends, s, side="right")
                else:
                    row = np.full(len(s), i)
                own, w = repeats.within(s, n, g32[width - GRAM:] == low, lambda w: g64[w], lambda w: g64[w + width - 64], True)
                inner = doc[row[own]], w + base - off[row[own]]
                yield repeats.Phrases(low[s], h, doc[row], s + base - off[row], n, inner)
    return phrases


def _located(width: int):
    def locate(raw, off, spans):
        row, s, n = flatten(spans)
        for k in range(0, len(row), 1 << 15):
            r, b, m = row[k:k + (1 << 15)], s[k:k + (1 << 15)], n[k:k + (1 << 15)]
            yield r, b, m, off[r] + b, off[r] + b + m + width - 1
    return locate


def _suffixes(width: int):
    def windows(raw, off, doc, s, n):
        _, g64 = _refine(raw[off[0]:off[-1]])
        start = off[:-1] - off[0]
        w, first = slices(start, n)
        return repeats.Phrases(g64[w], g64[w + width - 64], np.repeat(doc, n),
                               np.repeat(s, n) + np.arange(len(w)) - np.repeat(first[:-1], n), np.ones(len(w), np.int64))
    return windows


def covered(s: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs [start, end) of sorted window runs (s, n)."""
    if not len(s):
        return s, s
    end = np.maximum.accumulate(s + n + width - 1)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > end[:-1]
    head = np.flatnonzero(new)
    return s[head], end[np.append(head[1:], len(s)) - 1]


def _cut(width: int):
    def apply(batches):
        schema = pa.schema([("doc_id", pa.int64()), *OUT])
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            row, s, n = flatten(b.column("spans"))
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            out = np.zeros((3, b.num_rows), np.int64)
            sha = []
            for i in range(b.num_rows):
                lo, hi = covered(s[at[i]:at[i + 1]], n[at[i]:at[i + 1]], width)
                size = int(off[i + 1] - off[i])
                lo, hi = np.minimum(lo, size), np.minimum(hi, size)
                d, p = hashlib.sha256(), 0
                text = memoryview(raw[off[i]:off[i + 1]])
                for x, y in zip(lo.tolist(), hi.tolist()):
                    d.update(text[p:x])
                    p = y
                d.update(text[p:])
                sha.append(d.hexdigest())
                out[:, i] = size, int((hi - lo).sum()), len(lo)
            yield batch(schema, b.column("doc_id"), *out, pa.array(sha))
    return apply


def remove_repeated_bytes(documents: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document after
    each byte covered by a ``width``-byte string that also starts earlier
    (smaller doc_id, or same document and earlier start) is taken out."""
    if not 64 <= width <= 112:
        raise ValueError("width must be 64 to 112 bytes: two identifiers of depth 64 cover a string, three a pointer")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeats.repeated_spans(docs.where("doc_id is not null").withColumnRenamed("doc_id", "doc"),
                                   _pointers(width), _located(width), _suffixes(width), keep_first=True)
    return (docs.join(spans, docs["doc_id"] == spans["doc"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_cut(width), OUT_DDL))
