"""Numpy helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no component null or not finite, and not all zero."""
    each = vector.cast("array<double>")
    bad = F.exists(each, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(each, lambda x: x != 0.0), F.lit(False))


def rows_of(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` values, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def widths(df: DataFrame, vector: str) -> list[int]:
    """The lengths that vectors have: almost always one."""
    return sorted(r[0] for r in df.select(F.size(vector)).distinct().collect())
