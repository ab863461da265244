"""Vector columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column as doubles (null: NaN), first value and length of each row (null row: -1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths[column.is_null().to_numpy(zero_copy_only=False)] = -1
    values = column.values.cast(pa.float64(), safe=False)
    return values.to_numpy(zero_copy_only=False), offsets[:-1], lengths


def rows_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and matrix of the rows with exactly ``size`` components, all finite."""
    values, first, lengths = flat(column)
    at = np.flatnonzero(lengths == size)
    matrix = values[first[at][:, None] + np.arange(size)] if len(at) and size else np.zeros((len(at), size))
    good = np.isfinite(matrix).all(axis=1)
    return at[good], matrix[good]
