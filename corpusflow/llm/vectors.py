"""Vector columns as integers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimensions(vectors: DataFrame, vector: str) -> int | None:
    """The most frequent length of a vector (of two, the longer one), None without any; one row a length."""
    sizes = vectors.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    first = sizes.filter("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return first and first.d


def integers(column: pa.Array, scale: int, dims: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): numbers of a batch's usable rows, and floor(scale * component) of each. A row is usable
    where its vector has dims components, none of them null, not finite or beyond limit as an integer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    values = pc.cast(column.values, pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        floors = np.floor(values * scale)
        bad = np.append(0, np.cumsum(~(np.abs(floors) <= limit)))
    good = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) == dims) & (bad[at[1:]] == bad[at[:-1]])
    rows = np.flatnonzero(good)
    return rows, floors[at[rows, None] + np.arange(dims)].astype(np.int64)
