"""A polled service as a stream: its offset is the cursor.

Format ``polled_service``. A micro-batch asks for what is new since the cursor, the newest time that was seen. Services take late and
changed records, so every request begins ``overlap_hours`` before the cursor; what was seen before is told by its key
downstream (``ingest.upsert_into``). The requested time is cut into windows of ``window_hours``, a partition each, so a
first run over years is as many small requests, and a lost task repeats one of them. Spark's offset log is the saved
cursor: it is written before a batch, so a batch that fails is asked for again with the same bounds, and a poll
that finds nothing newer makes no batch and leaves the cursor alone.

What is asked is a subclass' ``newest`` and ``fetch``; the one here answers from Parquet files, as a replay does.
Options: path, schema (DDL), time (its column), overlap_hours, window_hours.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship


@dataclass
class Window(InputPartition):
    """Records from lo to hi, the last one with hi itself."""

    lo: str | None
    hi: str
    last: bool


def windows(cursor: str, newest: str, overlap_hours: float, window_hours: float, first: str | None = None) -> list[Window]:
    """Requests for what a cursor (empty: none yet) hasn't seen up to newest; without a cursor they begin at
    ``first``, or are one request for all."""
    end = dt.datetime.fromisoformat(newest)
    if cursor:
        at = dt.datetime.fromisoformat(cursor) - dt.timedelta(hours=overlap_hours)
    elif first:
        at = dt.datetime.fromisoformat(first)
    else:
        return [Window(None, newest, True)]
    step, out = dt.timedelta(hours=window_hours), []
    while at < end:
        out.append(Window(at.isoformat(), min(at + step, end).isoformat(), at + step >= end))
        at += step
    return out or [Window(at.isoformat(), newest, True)]


class PolledService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polled_service"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FilesReader({k.lower(): v for k, v in self.options.items()}, schema.fieldNames())


class PollReader(DataSourceStreamReader):
    """Offsets are {"cursor": newest time seen, "" before the first}."""

    overlap_hours, window_hours = 24.0, 24.0 * 30

    def newest(self) -> str | None:
        raise NotImplementedError

    def oldest(self) -> str | None:
        return None

    def fetch(self, window: Window) -> Iterator:
        raise NotImplementedError

    def initialOffset(self) -> dict:
        return {"cursor": ""}

    def latestOffset(self, *_) -> dict:
        return {"cursor": self.newest() or ""}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        return windows(start["cursor"], end["cursor"], self.overlap_hours, self.window_hours, None if start["cursor"] else self.oldest()) if end["cursor"] else []

    def read(self, partition: Window) -> Iterator:
        return self.fetch(partition)

    def commit(self, end: dict) -> None:
        """Spark's offset log has it."""


class FilesReader(PollReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.time, self.columns = options["path"], options["time"], columns
        self.overlap_hours, self.window_hours = float(options.get("overlap_hours", 24)), float(options.get("window_hours", 24 * 30))

    def _files(self) -> tuple[pafs.FileSystem, list[str]]:
        store, top = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = store.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True))
        return store, sorted(f.path for f in found if f.path.endswith(".parquet"))

    def _bound(self, which: str) -> str | None:
        """From the files' footers, no rows are read."""
        store, files = self._files()
        seen = []
        for name in files:
            meta = pq.read_metadata(store.open_input_file(name))
            column = meta.schema.to_arrow_schema().names.index(self.time)
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(column).statistics
                if s is not None and s.has_min_max:
                    seen.append(getattr(s, which))
        return (max if which == "max" else min)(seen).replace(tzinfo=None).isoformat() if seen else None

    def newest(self) -> str | None:
        return self._bound("max")

    def oldest(self) -> str | None:
        return self._bound("min")

    def fetch(self, window: Window) -> Iterator[pa.RecordBatch]:
        store, files = self._files()
        rows = pads.dataset(files, filesystem=store, format="parquet")
        kind = rows.schema.field(self.time).type
        at = lambda x: pa.scalar(dt.datetime.fromisoformat(x), pa.timestamp("us")).cast(kind)
        asked = pads.field(self.time) <= at(window.hi) if window.last else pads.field(self.time) < at(window.hi)
        if window.lo is not None:
            asked &= pads.field(self.time) >= at(window.lo)
        for batch in rows.to_batches(columns=self.columns, filter=asked):
            if batch.num_rows:
                yield batch


def poll(spark: SparkSession, path: str, schema: str, time: str, **options: object) -> DataFrame:
    """The stream of a service's records."""
    ship(spark)
    spark.dataSource.register(PolledService)
    return spark.readStream.format("polled_service").options(path=path, schema=schema, time=time, **{k: str(v) for k, v in options.items()}).load()
