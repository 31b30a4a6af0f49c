"""Finding equal windows of a fixed length in a corpus, in two exchanges.

Shared by the byte form (``bucket_refinement``) and the word form
(``rlz_dedup``). Every window is put under the smallest identifier of the short
grams inside it; equal windows choose equal grams, so windows that differ in it
never need comparing. Consecutive windows under one gram form a *phrase*.

1. Phrases, not windows, are exchanged by gram and sorted by phrase identifier:
   equal phrases settle all their windows at once.
2. Only phrases that share the gram with a different phrase are opened, and
   their windows exchanged by window identifier.

Equal windows of one phrase (periodic text keeps one smallest gram) are found
where the phrase is cut (``within``), as no other phrase need hold its gram.

Equal rows within a block are settled in the task that reads them, so one
task sends at most one row per phrase or window, however often it occurs.
A phrase identifier is 64 bits under a 64-bit gram, a window identifier 128.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsignals.llm.kernels import U, batch, groups, mix, text_buffer
from shopsignals.llm.span_lists import slices
from shopsignals.llm.tables import ship, store

ROWS = pa.schema([("open", pa.int8()), ("a", pa.int64()), ("h", pa.int64()),
                  ("doc", pa.int64()), ("s", pa.int64()), ("n", pa.int64())])
SPANS = pa.schema([("open", pa.int8()), ("doc", pa.int64()), ("s", pa.int64()), ("n", pa.int64())])
ROWS_DDL = "open byte, a long, h long, doc long, s long, n long"
SPANS_DDL = "open byte, doc long, s long, n long"
BLOCK_ROWS = 1 << 19  # rows settled together before they are sent


@dataclass(frozen=True)
class Phrases:
    """Phrases of one block: gram, phrase identifier, document, first window, windows;
    ``inner``: document and place of windows known to repeat inside their phrase."""

    a: np.ndarray
    h: np.ndarray
    doc: np.ndarray
    s: np.ndarray
    n: np.ndarray
    inner: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def runs(low: np.ndarray, ok: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of stretches of valid windows with one smallest gram."""
    if not len(low):
        e = np.zeros(0, np.int64)
        return e, e
    edge = np.empty(len(low) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
    b = np.flatnonzero(edge)
    s, n = b[:-1], np.diff(b)
    keep = ok[s]
    s, n = s[keep], n[keep]
    parts = -(-n // cut)
    if len(parts) and parts.max() > 1:
        i = np.repeat(np.arange(len(s)), parts)
        k = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
        s, n = s[i] + k * cut, np.minimum(cut, n[i] - k * cut)
    return s, n


def settle(a, h, doc, s, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Within one block: rows to send on (one per identifier), and rows whose
    content is known to repeat. ``keep_first``: the earliest place of equal
    content is not a repeat; otherwise all its places are."""
    send = np.ones(len(a), bool)
    hit = np.zeros(len(a), bool)
    key = mix(a, h)
    o = np.argsort(key, kind="stable")
    eq = key[o][1:] == key[o][:-1]
    if eq.any():
        member = np.zeros(len(o), bool)
        member[1:] |= eq
        member[:-1] |= eq
        m = o[member]
        m = m[np.lexsort((s[m], doc[m], h[m], a[m]))]
        first = np.ones(len(m), bool)
        first[1:] = (a[m][1:] != a[m][:-1]) | (h[m][1:] != h[m][:-1])
        head = np.flatnonzero(first)
        own = np.repeat(m[head], np.diff(np.append(head, len(m))))
        other = (doc[m] != doc[own]) | (s[m] != s[own])
        send[m] = first
        if keep_first:
            hit[m] = other
        else:
            several = np.logical_or.reduceat(other, head)
            hit[m] = np.repeat(several, np.diff(np.append(head, len(m))))
    return send, hit


def within(s, n, entered, first, second, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and window of the windows that repeat inside their phrase.

    ``entered``: the last gram of this window is its smallest. Equal windows hold
    the last of their smallest grams at one offset, so between them such a gram
    enters; phrases without one after their first window need no look. ``first``
    and ``second`` hold the two halves of a window's identifier."""
    after = np.flatnonzero(entered)
    p = np.searchsorted(s, after, side="right") - 1
    late = (p >= 0) & (after > s[p]) & (after < s[p] + n[p]) if len(s) else np.zeros(len(p), bool)
    some = np.unique(p[late])
    phrase, window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(some), 1 << 12):
        q = some[k:k + (1 << 12)]
        w, _ = slices(s[q], n[q])
        own = np.repeat(q, n[q])
        _, hit = settle(mix(first(w), own.astype(U)), second(w), own, w, keep_first)
        phrase.append(own[hit])
        window.append(w[hit])
    return np.concatenate(phrase), np.concatenate(window)


def join_spans(doc, s, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge window runs that touch, per document."""
    if not len(doc):
        return doc, s, n
    o = np.lexsort((s, doc))
    doc, s, n = doc[o], s[o], n[o]
    end = s + n
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] > end[:-1])
    # runs of one document come sorted and do not overlap, but for repeated rows
    head = np.flatnonzero(new)
    last = np.maximum.reduceat(end, head)
    return doc[head], s[head], last - s[head]


def settled(blocks: Iterator[Phrases], keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS for a stream of blocks: open 0 a finished span, 1 to compare."""
    held, rows = [], 0

    def flush():
        a, h, doc, s, n = (np.concatenate([getattr(p, f) for p in held]) for f in ("a", "h", "doc", "s", "n"))
        send, hit = settle(a, h, doc, s, keep_first)
        own, at = (np.concatenate([p.inner[i] for p in held]) for i in (0, 1))
        d, b, m = join_spans(*map(np.concatenate, ((doc[hit], own), (s[hit], at), (n[hit], np.ones(len(at), np.int64)))))
        spread = mix(d.view(U), b.view(U))  # finished spans are dealt out evenly
        yield batch(ROWS, np.zeros(len(d), np.int8), spread, np.zeros(len(d), np.int64), d, b, m)
        k = int(send.sum())
        yield batch(ROWS, np.ones(k, np.int8), a[send], h[send], doc[send], s[send], n[send])

    for p in blocks:
        if len(p.a):
            held.append(p)
            rows += len(p.a)
        if rows >= BLOCK_ROWS:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def compare(keep_first: bool, opens: bool) -> Callable:
    """Scan over rows sorted by (open, a, h, doc, s): which repeat, and which
    share the gram with a different phrase and must be opened. Only the first
    row of the last content is carried from batch to batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_row, head_hit, head_open, later = None, False, False, False
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            done = cols[0] == 0
            if done.any():
                yield batch(SPANS, np.zeros(int(done.sum()), np.int8), *(c[done] for c in cols[3:]))
                cols = [c[~done] for c in cols]
            if not len(cols[0]):
                continue
            if head_row is not None:
                cols = [np.concatenate((x, c)) for x, c in zip(head_row, cols)]
            _, a, h, doc, s, n = cols
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
            head = np.flatnonzero(new)
            own = head[np.cumsum(new) - 1]
            hit = (doc != doc[own]) | (s != s[own])
            if not keep_first:
                several = np.logical_or.reduceat(hit, head)
                several[0] &= not head_hit
                hit[head] = several
                head_hit = bool(several[-1]) or (len(head) == 1 and head_hit)
            yield batch(SPANS, np.zeros(int(hit.sum()), np.int8), doc[hit], s[hit], n[hit])
            if opens:
                again = np.empty(len(head), bool)  # the gram has an earlier content
                again[1:] = a[head[1:]] == a[head[:-1]]
                again[0] = later
                wide = again.copy()
                wide[:-1] |= again[1:]
                wide[0] &= not head_open
                o = head[wide]
                yield batch(SPANS, np.ones(len(o), np.int8), doc[o], s[o], n[o])
                later = bool(again[-1])
                head_open = bool(wide[-1]) or (len(head) == 1 and head_open)
            head_row = [c[head[-1]:head[-1] + 1] for c in cols]

    return scan


def exchange(rows: DataFrame, keep_first: bool, opens: bool) -> DataFrame:
    """Bring rows of one gram together, sorted (sorts spill), and scan them."""
    return (rows.repartition("a").sortWithinPartitions("open", "a", "h", "doc", "s")
            .mapInArrow(compare(keep_first, opens), SPANS_DDL))


def by_document(spans: DataFrame) -> DataFrame:
    """The spans of each document as one array (bounded by its own length)."""
    return spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("spans"))


def repeated_spans(texts: DataFrame, phrases: Callable, locate: Callable, windows: Callable, keep_first: bool) -> DataFrame:
    """(doc, spans): runs of windows of each document whose content repeats.

    ``texts``: doc (not null), text. ``phrases(raw, offsets, doc)`` gives the
    Phrases of one Arrow batch, block by block. ``locate(raw, offsets, spans)``
    gives row, s, n and byte range of the opened spans, and ``windows(raw,
    offsets, doc, s, n)`` the single windows of such byte ranges as Phrases."""
    ship(texts.sparkSession)

    def read_phrases(batches):
        def blocks():
            for b in batches:
                raw, off = text_buffer(b.column("text"))
                yield from phrases(raw, off, b.column("doc").to_numpy(zero_copy_only=False))
        return settled(blocks(), keep_first)

    def cut_out(batches):
        for b in batches:
            raw, off = text_buffer(b.column("text"))
            doc = b.column("doc").to_numpy(zero_copy_only=False)
            for row, s, n, lo, hi in locate(raw, off, b.column("spans")):
                at, cut = slices(lo, hi - lo)
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(cut), pa.py_buffer(raw[at])])
                yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(s), pa.array(n), body.cast(pa.binary())], ["doc", "s", "n", "body"])

    def read_windows(batches):
        def blocks():
            for b in batches:
                raw, off = text_buffer(b.column("body"))
                for i, j in groups(off):
                    yield windows(raw, off[i:j + 1], *(b.column(c).to_numpy(zero_copy_only=False)[i:j] for c in ("doc", "s", "n")))
        return settled(blocks(), keep_first)

    whole = store(exchange(texts.select("doc", "text").mapInArrow(read_phrases, ROWS_DDL), keep_first, True), "phrases")
    opened = by_document(whole.where("open = 1"))
    # cut out and stored: the texts' exchange is over before that of the windows
    bodies = store(texts.select("doc", "text").join(opened, "doc").mapInArrow(cut_out, "doc long, s long, n long, body binary"), "opened")
    single = store(exchange(bodies.mapInArrow(read_windows, ROWS_DDL), keep_first, False), "windows")
    return by_document(whole.where("open = 0").unionByName(single).select("doc", "s", "n"))
