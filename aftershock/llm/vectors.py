"""Vectors of a table: which take part, and as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Neither NULL, empty nor zero, and without NULL or non-finite components."""
    infinite = float("inf")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def lists(vectors: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, dimensions = vectors.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (n + 1) * dimensions, dimensions), pa.int32()), pa.array(vectors.ravel(), pa.float64())
    )
