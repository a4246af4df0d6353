"""Whitening of vectors by a tall-skinny QR, without a covariance.

A component c becomes x = floor(scale * c). The fit list holds each distinct x once.

1. Distinct vectors, packed into bytes, by one shuffle with partial aggregation; a table in the shared folder.
2. Exact sums. With S the sums and n the number, the mean is kept as its floor m, an integer, and the rest
   r / n in [0, 1): x - m is exact in int64, so a centred entry is rounded once.
3. Each partition folds its centred rows into one R factor, block by block; R factors are merged ``fan`` at a
   time, level by level, until one is left. All are dims x dims at most, whatever the number of rows.
4. SVD of the last R (on the driver): V = R'R / n, so right vectors are V's eigenvectors and s^2 / n its eigenvalues.
5. One scan of the fit list measures the covariance of the whitened vectors, one of all rows whitens them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

SCALE, COMPONENTS = 256, 4
LIMIT = 1 << 61
_LOW = (1 << 31) - 1


@dataclass
class Whitening:
    """A fitted transform; ``axes`` and ``eigenvalues`` have the components kept, the largest first."""

    n: int
    sums: list[int]
    axes: np.ndarray  # components x dims, unit rows
    eigenvalues: np.ndarray
    explained: np.ndarray
    scale: int

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.eigenvalues)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - sums)^2, exact. With y = x less the mean's floor and r what that leaves
        of the sums, each is n^2 y.y - 2 n r.y + r.r."""
        n, whole = self.n, np.array([s // self.n for s in self.sums], np.int64)
        y, r = x - whole, [s % n for s in self.sums]
        top = int(np.abs(y).max(initial=0))
        if self.dims * top * max(top, n) < 1 << 62:
            squares, products = (y * y).sum(1).tolist(), (y * np.array(r, np.int64)).sum(1).tolist()
        else:
            big = y.astype(object)
            squares, products = (big * big).sum(1).tolist(), (big * np.array(r, object)).sum(1).tolist()
        constant = sum(v * v for v in r)
        return [n * n * a - 2 * n * b + constant for a, b in zip(squares, products, strict=True)]


def _packed(x: np.ndarray) -> pa.Array:
    """Each row as bytes, in the narrowest width of 2, 4 or 8 bytes a component that holds all of them."""
    top = np.maximum(x, ~x).max(1, initial=0)
    out = np.empty(len(x), object)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 63)):
        at = np.flatnonzero((top >= low) & (top < high))
        for i, row in zip(at.tolist(), x[at].astype(kind), strict=True):
            out[i] = row.tobytes()
    return pa.array(out.tolist(), pa.binary())


def _unpacked(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    rows = column.to_pylist()
    for width in (2, 4, 8):
        at = [i for i, b in enumerate(rows) if len(b) == width * dims]
        if at:
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), f"<i{width}").reshape(-1, dims)
    return out


def fit_list(df: DataFrame, vector: str, scale: int, dims: int) -> DataFrame:
    """(x): each distinct usable vector once, as bytes."""

    def run(batches):
        for batch in batches:
            _, x = vectors.integers(batch.column(0), scale, dims, LIMIT)
            yield pa.RecordBatch.from_arrays([_packed(x)], ["x"])

    return df.select(F.col(vector)).mapInArrow(run, "x binary").distinct()


def exact_sums(points: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(number of rows, sum of each dimension). Tasks sum halves of 31 bits and what is above, so longs hold them."""

    def run(batches):
        high, low, n = np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
        for batch in batches:
            x = _unpacked(batch.column(0), dims)
            high, low, n = high + (x >> 31).sum(0), low + (x & _LOW).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(high), pa.array(low), pa.array([n] * dims, pa.int64())], ["dim", "high", "low", "n"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    rows = points.mapInArrow(run, "dim long, high long, low long, n long").groupBy("dim").agg(*wide).orderBy("dim").collect()
    return (int(rows[0].n) if rows else 0), [(int(r.high) << 31) + int(r.low) for r in rows]


_FACTOR = "node long, rows int, r binary"


def _factor(blocks: Iterator[np.ndarray], dims: int) -> np.ndarray:
    r = np.zeros((0, dims))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


def r_factor(points: DataFrame, of: Whitening, fan: int = 8) -> np.ndarray:
    """The R factor of all centred rows: one a partition, merged fan at a time."""
    dims = of.dims

    def leaf(batches):
        from pyspark import TaskContext

        r = _factor((of.centred(_unpacked(batch.column(0), dims)) for batch in batches if batch.num_rows), dims)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([len(r)], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["node", "rows", "r"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        r = _factor((np.frombuffer(b, float).reshape(-1, dims) for b in frame.r), dims)
        return pd.DataFrame({"node": [frame.node.iloc[0] // fan], "rows": [len(r)], "r": [r.tobytes()]})

    level = common.materialise(points.mapInArrow(leaf, _FACTOR), "factors")
    while level.count() > 1:  # a level a factor of fan: partitions' numbers are dense up to empty ones
        level = common.materialise(level.groupBy(F.expr(f"node div {fan}")).applyInPandas(merge, _FACTOR), "factors")
    last = level.first()
    return np.zeros((0, dims)) if last is None else np.frombuffer(last.r, float).reshape(-1, dims)


def fit(points: DataFrame, dims: int, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """The transform of a fit list. Components without variance, to the precision of doubles, are left out; an axis'
    greatest entry (the first of equal ones) is positive."""
    n, sums = exact_sums(points, dims)
    out = Whitening(n, sums or [0] * dims, np.zeros((0, dims)), np.zeros(0), np.zeros(0), scale)
    if not n:
        return out
    _, s, axes = np.linalg.svd(r_factor(points, out), full_matrices=False)
    kept = int((s > s.max(initial=0) * dims * 2.0**-48).sum()) if s.max(initial=0) > 0 else 0
    kept = min(kept, components)
    axes = axes[:kept]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1) < 0, -1.0, 1.0) if kept else axes
    out.axes, out.eigenvalues, out.explained = axes, s[:kept] ** 2 / n, s[:kept] ** 2 / (s**2).sum()
    return out


def identity_error(points: DataFrame, of: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity; 0 without components."""
    k, dims = len(of.axes), of.dims
    if not k:
        return 0.0

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = of.whiten(_unpacked(batch.column(0), dims))
            total += np.vstack([w.T @ w, w.sum(0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in points.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.i, r.j] = r.v / of.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


_ROWS = "key long, component int, n long, deviation long, whitened double, explained double"


def transform(df: DataFrame, of: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each usable row and component. A deviation that a long can't hold is null."""
    k, dims = len(of.axes), of.dims

    def run(batches):
        for batch in batches:
            rows, x = vectors.integers(batch.column(1), of.scale, dims, LIMIT)
            m = len(rows)
            deviation = [v if v < 1 << 63 else None for v in of.deviations(x)]
            columns = [
                batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([of.n] * (m * k), pa.int64()),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(of.whiten(x).ravel()), pa.array(np.tile(of.explained, m)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened", "explained"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).mapInArrow(run, _ROWS)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each usable row and component: key, component (from 1), n, deviation, whitened, explained,
    identity_error.

    Rows with a null vector, null or non-finite entries, entries beyond 2**61 as integers, or a length other than the most
    frequent one are left out. Repeated rows count once in the fit list and are whitened one by one; null keys are kept. No rows,
    one distinct vector or vectors without variance have no components, hence no rows. Other columns are not looked at.
    """
    common.ship(df.sparkSession)
    dims = vectors.dimensions(df, vector)
    if dims is None:
        empty = common.empty(df.sparkSession, _ROWS + ", identity_error double")
        return empty.withColumnRenamed("key", key)
    points = common.materialise(fit_list(df, vector, scale, dims), "points")
    of = fit(points, dims, components, scale)
    return transform(df, of, vector, key).withColumnRenamed("key", key).withColumn("identity_error", F.lit(identity_error(points, of)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings"))


ORACLE: dict[str, str] = {}
QUERIES = {"op12_whitening": op12_whitening}
