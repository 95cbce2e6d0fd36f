"""Arrow helpers for list-of-float columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def by_length(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each vector length; null vectors, and those with null or non-finite components, are left out."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.asarray(col.value_lengths().fill_null(-1)).astype(np.int64)
    flat = col.flatten()
    ok = np.isfinite(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)))
    values = np.where(ok, np.asarray(flat.cast(pa.float64()).fill_null(0.0)), 0.0)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    bad = np.concatenate([[0], np.cumsum(~ok)])
    good = (sizes >= 0) & (bad[starts + np.maximum(sizes, 0)] == bad[starts])
    out = []
    for n in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == n))
        out.append((rows, values[starts[rows][:, None] + np.arange(n)]))
    return out
