"""Pieces the corpus operators share: where tables are kept, numbering, reading."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import ship

#: `[^\x20\x09-\x0D]+`: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``. Only where that is
    unset and the session is a local one (as in tests) a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            base = f"file://{tempfile.mkdtemp(prefix='corpusflow-')}"
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def arrow_uri(spark: SparkSession, path: str) -> str:
    """path as pyarrow names it, for workers that open files of the shared folder themselves.
    ``spark.corpusflow.arrow.dir``, where set, is pyarrow's own name of the shared folder; else
    Hadoop's names of object stores become pyarrow's."""
    own = spark.conf.get("spark.corpusflow.arrow.dir", None)
    if own:
        return own.rstrip("/") + path.removeprefix(shared_dir(spark))
    scheme, sep, rest = path.partition("://")
    return {"s3a": "s3", "s3n": "s3", "gs": "gs", "wasbs": "abfss"}.get(scheme, scheme) + sep + rest


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    ship(spark)
    path = f"{shared_dir(spark)}/corpusflow/{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where.getParent())
    return path


#: Spark removes the shuffle files of an execution when it ends, not when their plan is collected.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and a
    lost executor costs a reread instead of the work before. The shuffles that made it are
    removed at once, since nothing reads them again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    was = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Give the memory that this worker has freed back to the system. Workers live from one
    operator to the next, and their allocators keep what the last one needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A function for mapInArrow that trims the worker's memory before and after."""

    def whole(batches):
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame, unknown: int = 1 << 28) -> int:
    """Catalyst's estimate of what df reads, or ``unknown`` where it has none (rows that
    come from the driver); it sizes sketches and partitions, never results."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = size if isinstance(size, int) else int(size.toString())
    return size if size < 1 << 50 else unknown


def numbered(df: DataFrame, group: list[str], key: str | list[str], name: str, spread: int = 64) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each group.

    A group may hold a third of all rows, so no task gets a whole group: rows are
    salted into ``spread`` buckets by a hash of ``key``; buckets are counted first
    (a table of at most groups x spread rows), their running totals give each
    bucket's first number, and rows are numbered inside their bucket by ``key``.
    Numbers depend on the rows alone, so reruns agree. df should be materialised:
    it is read twice.
    """
    keys = [key] if isinstance(key, str) else key
    salt = f"__salt_{name}"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*keys), F.lit(spread)).cast("int"))
    totals = salted.groupBy(*group, salt).agg(F.count(F.lit(1)).alias("__n"))
    running = W.partitionBy(*group).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    first = totals.withColumn("__first", F.coalesce(F.sum("__n").over(running), F.lit(0))).drop("__n")
    inside = salted.withColumn("__row", F.row_number().over(W.partitionBy(*group, salt).orderBy(*keys)) - 1)
    return (
        inside.join(first, [*group, salt])
        .withColumn(name, (F.col("__row") + F.col("__first")).cast("long"))
        .drop("__row", "__first", salt)
    )


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
