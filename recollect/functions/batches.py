"""Bounded shares of Arrow batches, so that a worker's memory follows neither their rows nor their texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes or values worked on at once; a single larger row is a share by itself.
ROWS, SIZE = 500, 1 << 20


def shares(sizes: Iterable[int], size: int = SIZE, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Ranges ``first, end`` of consecutive rows with about ``size`` together, one row at least."""
    first = total = end = 0
    for own in sizes:
        if end > first and (total + own > size or end - first >= rows):
            yield first, end
            first, total = end, 0
        total += own
        end += 1
    if end > first:
        yield first, end


def text_shares(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in consecutive slices of bounded bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    return (texts.slice(a, b - a) for a, b in shares(sizes))


def list_shares(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive slices of bounded numbers of values in the lists of ``column``."""
    sizes = np.diff(batch.column(column).offsets.to_numpy()).tolist()
    return (batch.slice(a, b - a) for a, b in shares(sizes))


def give_back() -> None:
    """Return freed memory to the machine, which a worker between two tasks would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
