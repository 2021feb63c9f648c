"""Reading embedding columns of Arrow batches into matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, float64 matrix) for every vector length in the batch.

    Null and empty vectors and those that hold null or non-finite components are left out.
    """
    col = batch.column(column)
    lengths = np.asarray(col.value_lengths().fill_null(0))
    values = np.asarray(col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    starts = np.cumsum(lengths) - lengths
    for width in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == width)
        matrix = values[starts[rows][:, None] + np.arange(width)]
        whole = np.isfinite(matrix).all(axis=1)
        if whole.any():
            yield rows[whole], matrix[whole]
