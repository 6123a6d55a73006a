"""Vectors as rows: which take part, in which dimension, and Arrow batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool) -> Column:
    """Whether a vector has components, all of them finite; with ``zero`` also one of nothing but zeros passes."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    some = F.lit(True) if zero else F.exists(vector, lambda x: x != 0)
    return F.coalesce((F.size(vector) > 0) & finite & some, F.lit(False))


def commonest_size(df: DataFrame, column: str) -> int:
    """The dimension most vectors of a stored table have, the smaller one of equally common ones; 0 for an empty table."""
    row = df.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def matrix(column: pa.Array, size: int, kind=np.float64) -> np.ndarray:
    """An Arrow column of lists of ``size`` numbers as a matrix of one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), size)
