"""Vectors of a table as exact integer matrices, for the operators over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def scaled(column: pa.Array, scale: int, most: float = 2.0**62) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length among the lists: the places of its lists and ``floor(scale * x)`` of their components.

    Lists that are null or hold a null or a value that is not finite are left
    out.  ``scale`` is a power of two, so the float64 matrix is exact.
    A component beyond ``most`` is an error, as results would not fit 64 bits.
    """
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)  # a null is not a number here
    ends = np.cumsum(lengths)
    odd = np.append(0, np.cumsum(~np.isfinite(values)))
    whole = np.asarray(pc.is_valid(column).to_numpy(zero_copy_only=False)) & (odd[ends] == odd[ends - lengths])
    for length in np.unique(lengths[whole]):
        places = np.flatnonzero(whole & (lengths == length))
        matrix = np.floor(scale * values[(ends - lengths)[places, None] + np.arange(length)])
        if matrix.size and np.abs(matrix).max() > most:
            raise ValueError(f"a component times {scale} exceeds {most:.0f}")
        yield places, matrix


def packed(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes as a binary value."""
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize if matrix.ndim == 2 else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(matrix))])


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The matrix whose rows ``packed`` has written; all values are valid and equally long."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]].view(kind).reshape(len(column), -1)
