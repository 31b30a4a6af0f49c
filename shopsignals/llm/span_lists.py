"""Reading arrays of (s, n) spans from an Arrow list column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flatten(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, start and number of windows of every span (null list: none)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.where(np.asarray(col.is_valid()), np.diff(col.offsets.to_numpy()), 0)
    flat = col.flatten()
    return (np.repeat(np.arange(len(col)), size), flat.field("s").to_numpy(zero_copy_only=False),
            flat.field("n").to_numpy(zero_copy_only=False))


def slices(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of many slices laid end to end, and the slices' offsets there."""
    off = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(off[-1]) - np.repeat(off[:-1], length) + np.repeat(start, length)
    return at, off
