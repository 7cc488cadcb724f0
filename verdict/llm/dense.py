"""Vectors of Arrow list columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def vectors(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, offsets, ok) of a list column: the components of row i are
    ``values[offsets[i]:offsets[i + 1]]``, in double precision; ok is false for
    null rows and rows with null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.r_[0, np.cumsum(size)]
    flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    wrong = np.r_[0, np.cumsum(~np.isfinite(flat))]
    ok = pc.is_valid(column).to_numpy(zero_copy_only=False) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    return flat, offsets, ok


def packed(values: np.ndarray, offsets: np.ndarray, kept: np.ndarray, kind: str) -> pa.Array:
    """Each row's values as bytes, null where not kept."""
    data = values.astype(kind)
    raw = data.tobytes()
    at = offsets * data.itemsize
    return pa.array([raw[a:z] if k else None for a, z, k in zip(at[:-1], at[1:], kept)], pa.binary())


def stack(rows: list[bytes], kind: str, width: int) -> np.ndarray:
    """Rows of packed values as a matrix; shorter rows end in zeros."""
    size = np.dtype(kind).itemsize * width
    return np.frombuffer(b"".join(r.ljust(size, b"\0") for r in rows), kind).reshape(len(rows), width)
