"""Vector columns: dot product, cosine distance, float32 blobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_matrix(column: pa.Array) -> np.ndarray:
    """A list<float> Arrow column as an (n, d) matrix without copying the values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0), dtype=np.float32)
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count or (lengths != lengths[0]).any():
        raise ValueError("embedding dimension mismatch inside one column")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, int(lengths[0]))


def matrix_list(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=pa.float32()))


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]


@F.arrow_udf(T.DoubleType())
def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    known = pc.and_(pc.is_valid(a), pc.is_valid(b))
    if not pc.all(known).as_py():
        a, b = a.filter(known), b.filter(known)
    starts = a.offsets.to_numpy()
    sizes = np.diff(starts)
    if not np.array_equal(sizes, np.diff(b.offsets.to_numpy())):
        raise ValueError("embedding dimension mismatch")
    x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in (a, b))
    if len(sizes) and (sizes == sizes[0]).all():
        found = np.einsum("ij,ij->i", x.reshape(len(sizes), sizes[0]), y.reshape(len(sizes), sizes[0]))
    else:
        found = np.diff(np.concatenate([[0.0], np.cumsum(x * y)])[np.concatenate([[0], np.cumsum(sizes)])])
    out = np.full(len(known), np.nan)
    mask = known.to_numpy(zero_copy_only=False)
    out[mask] = found
    return pa.array(out, mask=~mask)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vector columns in double precision, a batch at a time; unequal lengths
    raise, a null vector gives null."""
    return _dot(a, b)


@F.arrow_udf(T.ArrayType(T.FloatType(), containsNull=False))
def decode_float32(blob: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to a vector; a null is an empty one."""
    if not len(blob):
        return pa.array([], pa.list_(pa.float32()))
    if blob.null_count:
        blob = pc.fill_null(blob, b"")
    offsets = _offsets(blob)
    if (offsets % 4 != offsets[0] % 4).any():
        raise ValueError("a blob is no whole number of floats")
    raw = blob.buffers()[2]
    values = np.frombuffer(raw.to_pybytes() if raw else b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    places = ((offsets - offsets[0]) // 4).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(np.frombuffer(values.tobytes(), dtype="<f4")))


@F.arrow_udf(T.BinaryType())
def encode_float32(vector: pa.Array) -> pa.Array:
    """A vector as little-endian float32 bytes; a null stays null."""
    offsets = (np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(vector), 0).to_numpy(zero_copy_only=False)])) * 4).astype(np.int32)
    values = vector.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    out = pa.BinaryArray.from_buffers(pa.binary(), len(vector), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    return pc.if_else(pc.is_valid(vector), out, None) if vector.null_count else out
