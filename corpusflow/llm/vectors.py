"""Shared pieces of the vector operators: usable rows, pivots, blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side in a dealt block, and in one matrix product.
BLOCK, CHUNK = 8192, 1024


def usable(column: str) -> Column:
    """Neither null nor empty, and every component a finite number."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~bad


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equal lengths as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def pivots(rows: DataFrame, key: str, column: str, n: int, seed: int = 41) -> np.ndarray:
    """``n`` vectors by least seeded hash (a top-n of the driver), distinct."""
    got = rows.select(column, F.xxhash64(F.lit(seed), key).alias("h"), key).orderBy("h", key).limit(n).collect()
    if not got:
        return np.empty((0, 0))
    return np.unique(np.array([list(r[column]) for r in got], "float64"), axis=0)
