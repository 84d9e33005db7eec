"""Vectors of an Arrow list column as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str | Column) -> Column:
    """Whether a vector is there, not empty, and holds neither null nor non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
