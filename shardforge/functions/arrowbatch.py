"""Arrow <-> NumPy for array columns inside ``mapInArrow`` tasks, without
going through Python lists: a list column of equal-length rows becomes a
(rows, dim) matrix view of its flat values buffer, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(col, dtype=np.float64) -> np.ndarray:
    """(rows, dim) matrix of a list<number> Arrow column with equal lengths."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0), dtype=dtype)
    offsets = col.offsets.to_numpy()
    lengths = np.diff(offsets)
    dim = int(lengths[0])
    if not (lengths == dim).all():
        raise ValueError("array column rows have different lengths")
    values = col.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return values.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, dim)


def from_matrix(mat: np.ndarray, value_type=pa.float64()) -> pa.ListArray:
    """list<double> Arrow column from a (rows, dim) matrix."""
    rows, dim = mat.shape
    offsets = pa.array(np.arange(0, rows * dim + 1, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mat).ravel(), type=value_type))
