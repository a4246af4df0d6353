"""What a session needs to run this package's Python code on executors."""

from __future__ import annotations

import itertools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch: by rows alone, batches of long texts would fill a worker.
BATCH = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the user has, and send this package to the
    executors, once: they may have neither the driver's folders nor its module path."""
    context = spark.sparkContext
    if not context.getConf().contains(_BYTES):
        spark.conf.set(_BYTES, BATCH)
    if getattr(context, "_corpusflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="corpusflow-")) / "corpusflow-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(path))
    context._corpusflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in a local session
    that has none a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='corpusflow-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here and its statistics are
    known. The folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusflow/{uuid.uuid4().hex}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where.getParent())
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int = 4) -> DataFrame:
    """df dealt out to so many tasks a core. A small file is one task or a few, however much work its rows make."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism * tasks, df.rdd.getNumPartitions()))


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, to be broadcast if it has so many rows at most; else as it is, and the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def blocks(df: DataFrame, rows: int = 1000) -> Iterator[DataFrame]:
    """df, a configuration that is tried on every row of a table, as frames of so many rows at most, each to
    be broadcast; one is on the driver at a time."""
    left = df.toLocalIterator()
    part = list(itertools.islice(left, rows))
    while True:
        yield F.broadcast(df.sparkSession.createDataFrame(part, df.schema))
        part = list(itertools.islice(left, rows))
        if not part:
            return


def arrow_uri(spark: SparkSession, path: str) -> str:
    """path in the shared folder as pyarrow names it; ``spark.corpusflow.arrow.dir`` is its own name of
    that folder, where it differs from Hadoop's by more than the scheme."""
    own = spark.conf.get("spark.corpusflow.arrow.dir", None)
    if own:
        return own.rstrip("/") + path.removeprefix(shared_dir(spark))
    scheme, sep, rest = path.partition("://")
    return {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}.get(scheme, scheme) + sep + rest
