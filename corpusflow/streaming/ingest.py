"""The merge policies on streams: each run takes what is new and ends.

File sources with a checkpoint stand for cursors: a file is read once. Late and repeated
rows are settled by key, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import merge


def available(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder; files_per_batch bounds a batch (bounded rollout)."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Take all that is there, batch by batch, and end."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def upsert_into(spark: SparkSession, path: str, key: str, stamp: str | None) -> Callable[[DataFrame, int], None]:
    """foreachBatch: merge a batch into a table kept as deltas, ``path/v=<batch>``, each with the rows
    that its batch inserted or updated. A batch reads only what the table has of its own keys, and
    one that is run again writes the same delta again. stamp None: insert only."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        deltas = versions(spark, path, number)
        if deltas is not None:
            known = _newest(deltas.join(rows.select(key), key, "left_semi"), key)
            plan = merge.by_value(rows, known, key, stamp) if stamp else merge.insert_only(rows, known, key)
            rows = plan.filter(F.col("action").isin("insert", "update")).select(batch.columns)
        rows.write.mode("overwrite").parquet(f"{path}/v={number}")

    return each


def versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of all deltas (or of those before a batch) with their v. A folder without Spark's
    mark of success was never finished and isn't read."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    done = [n for n in done if before is None or int(n[2:]) < before]
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in sorted(done)]) if done else None


def _newest(deltas: DataFrame, key: str) -> DataFrame:
    columns = [c for c in deltas.columns if c != "v"]
    newest = deltas.groupBy(key).agg(F.max_by(F.struct(*columns), "v").alias("__row"))
    return newest.select(*[F.col("__row").getField(c).alias(c) for c in columns])


def latest(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The table: each key's newest row."""
    deltas = versions(spark, path)
    return None if deltas is None else _newest(deltas, key)


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "24 hours") -> DataFrame:
    """The first row of each key; keys are remembered for as long as rows may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sliding_counts(stream: DataFrame, time: str, key: str, size: str = "30 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts in sliding windows: the moving window of emergence on a stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size, slide), key).agg(F.count(F.lit(1)).alias("n"))


class Ledger(StatefulProcessor):
    """Distinct observation days of each slug; gives (slug, runs) when a new one comes. The number is kept beside the days, so a
    batch costs its own rows, not the slug's history."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day string", "seen boolean")
        self.runs = handle.getValueState("runs", "n long")

    def handleInputRows(self, key, rows, timer):
        before = self.runs.get()[0] if self.runs.exists() else 0
        n = before
        for pdf in rows:
            for day in pdf["day"].astype(str).unique():
                if not self.days.containsKey((day,)):
                    self.days.updateValue((day,), (True,))
                    n += 1
        if n > before:
            self.runs.update((n,))
            yield pd.DataFrame({"slug": [key[0]], "runs": [n]})

    def close(self) -> None:
        pass


def ledger(stream: DataFrame) -> DataFrame:
    """stream (slug, day) -> (slug, runs), by keyed state that outlives a run (needs the
    RocksDB state store)."""
    return stream.groupBy("slug").transformWithStateInPandas(Ledger(), "slug string, runs long", "Update", "None")


def ledger_into(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take all of stream (slug, day) into the ledger whose state is at checkpoint, and keep its numbers as a keyed
    table at path. The state is saved with a batch's offsets before its numbers are written, and a batch that is run
    again writes the same numbers again."""
    store = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = ledger(stream).writeStream.outputMode("update").foreachBatch(upsert_into(spark, path, "slug", "runs")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(store) if was is None else spark.conf.set(store, was)
