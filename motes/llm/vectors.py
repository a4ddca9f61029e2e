"""Vectors of the embedding operators: whole components, packed as little-endian 32-bit integers.

A component x becomes floor(256 * x), x as a double. A vector that is null, or has a null or non-finite component, is no vector; nor is one with
a component of 2**25 or more in size after scaling, so that sums of up to 2048 products of two components are exact as longs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCALE = 256
LIMIT = 1 << 25


def packed_vectors(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, pa.Array]:
    """Which rows of a list column are vectors (of dims components, if given), and the packed vectors of those rows."""
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(SCALE * flat)
    fine = np.isfinite(whole) & (np.abs(whole) < LIMIT)
    owner = np.repeat(np.arange(len(lens)), lens)
    keep = np.bincount(owner[~fine], minlength=len(lens)) == 0
    keep &= pc.is_valid(column).to_numpy(zero_copy_only=False)
    if dims is not None:
        keep &= lens == dims
    data = whole[keep[owner]].astype("<i4")
    ends = np.concatenate(([0], np.cumsum(4 * lens[keep]))).astype(np.int64)
    return keep, pa.Array.from_buffers(pa.large_binary(), int(keep.sum()), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(vectors: list[bytes] | pa.Array) -> np.ndarray:
    """Packed vectors of one length as a matrix of 64-bit integers."""
    held = vectors.to_pylist() if isinstance(vectors, (pa.Array, pa.ChunkedArray)) else list(vectors)
    return np.frombuffer(b"".join(held), "<i4").reshape(len(held), -1 if held and held[0] else 0).astype(np.int64)

