"""Vectors between Spark's arrays and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, and no component that is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out
