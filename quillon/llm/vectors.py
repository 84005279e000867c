"""What the two vector operators share: clean rows, and blocks of vectors that meet in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column, all of `dim` components, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), dim)


def dealt(blocks: Column | int, *keys: str) -> Column:
    """A block number below `blocks`, by hash of the keys."""
    return F.pmod(F.xxhash64(*keys), blocks if isinstance(blocks, Column) else F.lit(blocks)).cast("int")
