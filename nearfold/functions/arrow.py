"""Arrow batches as matrices and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a (rows, dim) double array; (0, 0) if empty. Raises if lengths differ."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim, rest = divmod(len(flat), len(column))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if rest or (lengths != dim).any():
        raise ValueError("vectors of a table must be non-null and of one length")
    if np.isnan(flat).any():
        raise ValueError("vectors must not hold nulls or NaN")
    return flat.reshape(len(column), dim)


def vectors(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32), pa.array(m.ravel()))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
