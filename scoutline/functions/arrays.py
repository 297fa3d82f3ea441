"""Expressions over ARRAY<DOUBLE> columns, and the Arrow view of the same columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def array_sum(col: Column | str) -> Column:
    return F.aggregate(_c(col), F.lit(0.0), lambda acc, x: acc + x)


def normalised(col: Column | str) -> Column:
    """The array divided by its own sum."""
    total = array_sum(col)
    return F.transform(_c(col), lambda x: x / total)


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def to_matrix(column, width: int | None = None) -> np.ndarray:
    """Arrow list column -> 2-D float64 array without going through Python objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    rows = len(column)
    if rows == 0:
        return flat.reshape(0, width or 0)
    return flat.reshape(rows, -1)
