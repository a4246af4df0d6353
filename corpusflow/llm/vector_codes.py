"""Vector code compression: product quantisation, exact in integers.

A component c becomes floor(scale * c). Vectors are cut into equal parts; each part position has a
codebook. A round is one scan of the vectors: tasks assign every part to its nearest entry and emit the sums
and counts of each entry (parts x entries rows a task), Spark adds them up, and the driver, which
holds the codebooks only, divides. Nothing else is written, so a lost executor costs a part of a scan.

Nearest entries are screened by one float32 matrix product a part: score(j) = |c_j|^2 - 2 x.c_j orders
entries as their squared distances do. Where u = 2^-24 and d is the part's length, the rounded product
of rounded factors is off by at most g |x| |c_j| with g = (1 + u)^2 (1 + du / (1 - du)) - 1, whatever the order
of the sums, fused or not (integers don't underflow); the scores' own float64 roundings are added to that. An
entry whose interval lies above the least upper end can't be the nearest; where others remain, their distances
are computed in int64 and the least index wins a tie.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


@dataclass
class Codebooks:
    """entries[p, j] is entry j of part position p."""

    entries: np.ndarray  # int64, parts x entries x length of a part
    scale: int
    limit: int

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def longest(dims: int) -> int:
    """The largest component for which the squared distances of whole vectors stay below 2**62."""
    return math.isqrt((1 << 62) // dims) // 2


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each row of x the entry of book with the least squared distance, the first of equal ones."""
    d, u = x.shape[1], 2.0**-24
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    exact = (book * book).sum(1)
    square = exact.astype(np.float64)
    score = square - 2 * product
    relative = (1 + u) ** 2 * (1 + d * u / (1 - d * u)) - 1
    lengths = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(square)
    slack = (2 * relative * lengths + 2.0**-50 * (square + 2 * np.abs(product) + 2 * lengths)) * (1 + 2.0**-20)
    open_ = score - slack <= (score + slack).min(1)[:, None]
    best = open_.argmax(1)
    row, entry = np.nonzero(open_ & (open_.sum(1) > 1)[:, None])
    if len(row):
        step = x[row] - book[entry]
        gap = (step * step).sum(1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(gap, first)
        winner = np.where(gap == np.repeat(least, np.diff(np.append(first, len(row)))), entry, len(book))
        best[row[first]] = np.minimum.reduceat(winner, first)
    return best


def _read(column: pa.Array, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    parts, _, length = books.entries.shape
    rows, x = vectors.integers(column, books.scale, books.dims, books.limit)
    return rows, x.reshape(len(x), parts, length)


def _first(df: DataFrame, scale: int, dims: int, limit: int, entries: int) -> np.ndarray:
    """The usable vectors with the least keys."""

    def run(batches):
        for batch in batches:
            rows, x = vectors.integers(batch.column(1), scale, dims, limit)
            keys = [batch.column(0)[i].as_py() for i in rows.tolist()]
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0))
            if len(order) > entries and keys[order[entries - 1]] is not None:  # all with the last one's key, too
                order = [i for i in order if keys[i] is not None and keys[i] <= keys[order[entries - 1]]]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in order], pa.int64()), pa.array(x[order].tolist(), pa.list_(pa.int64()))], ["key", "x"])

    found = df.select("key", "vector").mapInArrow(run, "key long, x array<long>").orderBy(F.col("key").asc_nulls_last(), "x").limit(entries).collect()
    return np.array([r.x for r in found], np.int64).reshape(len(found), dims)


def _renamed(df: DataFrame, vector: str, key: str, label: Column | None = None) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), (F.lit(None) if label is None else label).alias("label"))


def train(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after some rounds over all usable vectors; None where there is none.

    They start as the vectors with the least keys (null keys last, rows of one key by their components); fewer than
    ``entries`` vectors give as many entries. An entry that no part is assigned to stays as it is.
    """
    dims = vectors.dimensions(df, vector)
    if dims is None:
        return None
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    common.ship(df.sparkSession)
    limit, length = longest(dims), dims // parts
    given = _renamed(df, vector, key)
    start = _first(given, scale, dims, limit, entries)
    if not len(start):
        return None
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, length).swapaxes(0, 1)), scale, limit)
    names = [f"s{i}" for i in range(length)]
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]
    for _ in range(rounds):
        rows = given.select("vector").mapInArrow(_summing(books), f"part int, entry int, n long, {', '.join(c + ' long' for c in names)}")
        for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            books.entries[r.part, r.entry] = [int(r[c]) // r.n for c in names]
    return books


def _summing(books: Codebooks):
    parts, entries, length = books.entries.shape

    def run(batches):
        total, count = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, x = _read(batch.column(0), books)
            for p in range(parts):
                code = nearest(x[:, p], books.entries[p])
                count[p] += np.bincount(code, minlength=entries)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(x[order, p], first)
        part, entry = np.nonzero(count)
        columns = [part.astype(np.int32), entry.astype(np.int32), count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["part", "entry", "n", *(f"s{i}" for i in range(length))])

    return run


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, label, code, error): of each usable vector, the index of each part's nearest entry as two hex digits,
    and the squared distances summed. Rows with one key are coded one by one."""
    parts = books.entries.shape[0]
    kind = df.schema[label].dataType

    def run(batches):
        for batch in batches:
            rows, x = _read(batch.column(1), books)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p] = nearest(x[:, p], books.entries[p])
                step = x[:, p] - books.entries[p, codes[:, p]]
                error += (step * step).sum(1)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["key", "label", "code", "error"])

    given = _renamed(df, vector, key, F.col(label))
    schema = given.select("key", "label").schema.add("code", "string").add("error", "long")
    schema["label"].dataType = kind
    return given.mapInArrow(run, schema)


def decode(code: str, books: Codebooks) -> np.ndarray:
    """The vector that a code stands for."""
    at = np.frombuffer(bytes.fromhex(code), np.uint8)
    return (books.entries[np.arange(len(at)), at].ravel() + 0.5) / books.scale


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", frequent: int = 512, **shape: int) -> DataFrame:
    """One row a usable vector: key, code, error, label_error (the errors of all rows with its label), codebooks_sha256.

    Rows with a null vector, null or non-finite components, components whose square doesn't fit (``longest``), or
    a length other than the most frequent one are left out; an empty table gives no rows. Null keys and labels
    are kept, null labels are equal to each other. Other columns are not looked at. Totals of labels with
    1 / frequent of the rows, fewer than ``frequent`` of them, are broadcast; the other labels shuffle.
    """
    books = train(df, vector, key, **shape)
    if books is None:
        return df.limit(0).select(F.col(key).cast("long").alias(key), F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    coded = common.materialise(encode(df, books, vector, key, label), "codes")
    totals = common.materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "labels")
    n = totals.agg(F.sum("rows")).first()[0] or 0
    hot = totals.filter(F.col("rows") > n / frequent).withColumnRenamed("label", "hot")
    cold = totals.filter(F.col("rows") <= n / frequent).withColumnRenamed("label", "cold")
    split = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("hot")), "left")
    chosen = ["key", "code", "error", "label_error"]
    rare = split.filter("rows is null").select("key", "code", "error", "label").join(cold, F.col("label").eqNullSafe(F.col("cold")))
    out = split.filter("rows is not null").select(chosen).unionByName(rare.select(chosen))
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds as common table expressions, one after another."""
    length = "len(v) // 8"
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"cut AS (SELECT vec_id, p, v[p * ({length}) + 1 : (p + 1) * ({length})] AS x FROM kept, range(8) AS r(p))",
        "b0 AS (SELECT p, j, x AS c FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept QUALIFY j < 16) JOIN cut USING (vec_id))",
    ]
    gap = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(7):
        steps.append(f"a{i} AS (SELECT vec_id, p, x, j, {gap} AS gap FROM cut JOIN b{i} USING (p) QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY {gap}, j) = 1)")
        if i < 6:
            steps.append(f"m{i} AS (SELECT p, j, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 1 + (SELECT max(len(x)) FROM cut)) AS r(i) GROUP BY p, j, i)")
            steps.append(f"n{i} AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{i} GROUP BY p, j)")
            steps.append(f"b{i + 1} AS (SELECT p, j, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (p, j))")
    steps.append("coded AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(gap)::BIGINT AS error FROM a6 GROUP BY vec_id)")
    steps.append("books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b6)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (vec_id), books"


ORACLE = {"op11_vector_codes": _oracle()}
QUERIES = {"op11_vector_codes": op11_vector_codes}
