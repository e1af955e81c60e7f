"""Vectors in columns: which of them are sound, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: str) -> Column:
    """Whether a vector has entries and all of them are finite numbers; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` numbers each, as rows in double precision."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
