"""Vectorised text kernels used inside Arrow batches.

Texts stay UTF-8 bytes in one Arrow buffer; words, grams and their 64-bit
identifiers are numpy arrays over that buffer. A word is a run of bytes other
than space and 0x09-0x0D; it is kept unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LANE_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U)
# odd multipliers of the identifier mixes
M1, M2, M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
GROUP_BYTES = 1 << 21


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def groups(offsets: np.ndarray, size: int = GROUP_BYTES):
    """Row ranges (i, j) of about ``size`` bytes; a longer row is one range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def load8(x: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one integer (zeros past the end)."""
    padded = np.zeros(len(x) + 8, np.uint8)
    padded[:len(x)] = x
    return np.ndarray((len(x) + 1,), "<u8", buffer=padded, strides=(1,))


def mix(a: np.ndarray, b: np.ndarray, shift: int = 29) -> np.ndarray:
    """Identifier of a pair of identifiers."""
    h = a * M1
    h += b * M2
    h ^= h >> U(shift)
    return h


def words(raw: np.ndarray, offsets: np.ndarray):
    """Start, end (positions in ``raw``) and row index of every word."""
    a, b = int(offsets[0]), int(offsets[-1])
    if b <= a:
        e = np.zeros(0, np.int64)
        return e, e, e
    sep = SEPARATORS[raw[a:b]]
    before = np.empty(b - a, bool)
    before[0] = True
    before[1:] = sep[:-1]
    after = np.empty(b - a, bool)
    after[-1] = True
    after[:-1] = sep[1:]
    edges = offsets[1:-1] - a
    edges = edges[(edges > 0) & (edges < b - a)]
    before[edges] = True
    after[edges - 1] = True
    ws = np.flatnonzero(~sep & before)
    we = np.flatnonzero(~sep & after) + 1
    row = np.searchsorted(offsets[1:] - a, ws, side="right")
    return ws + a, we + a, row


def word_ids(raw: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """64-bit identifier of each word's bytes, eight bytes a step."""
    if not len(ws):
        return np.zeros(0, U)
    a, b = int(ws[0]), int(we[-1])
    lanes = load8(raw[a:b])
    at, left = ws - a, we - ws
    h = left.astype(U) * M3
    todo = np.arange(len(ws))
    while len(todo):
        p, rest = at[todo], left[todo]
        v = lanes[p] & LANE_MASK[np.minimum(rest, 8)]
        g = (h[todo] ^ v) * M1
        g ^= g >> U(32)
        h[todo] = g * M2
        more = rest > 8
        todo = todo[more]
        at[todo] += 8
        left[todo] -= 8
    h ^= h >> U(31)
    return h


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Identifiers of all runs of ``k`` consecutive ids, by doubling: the
    identifier at depth 2d pairs those at depth d of this and a later offset."""
    g, d = ids, 1
    while d < k:
        step = min(d, k - d)
        if len(g) <= step:
            return np.zeros(0, U)
        g = mix(g[:-step], g[step:], 29 + (d % 3))
        d += step
    return g


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by doubling."""
    d = 1
    while d < w:
        step = min(d, w - d)
        if len(v) <= step:
            return np.zeros(0, v.dtype)
        v = np.minimum(v[:-step], v[step:])
        d += step
    return v


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    """A record batch from numpy columns (uint64 read as signed)."""
    arrays = [c if isinstance(c, pa.Array) else
              pa.array(c.view(np.int64) if c.dtype == U else c, f.type) for c, f in zip(cols, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
