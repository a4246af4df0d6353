"""Media columns: payloads as lossless images in archives, read by a custom data source.

Writer: a task turns each payload into an 8-bit greyscale PNG, 576 samples wide, and
appends it to a ZIP archive of bounded size in the shared folder. Archives carry a
unique name for each attempt; those of the tasks that Spark counts are in a manifest,
so a lost or repeated attempt leaves no rows behind.

Reader (format ``media_archives``): the driver plans byte ranges over the archives
from their sizes alone. A task reads the directory at the archive's end, takes the
members whose header starts in its range and streams them as Arrow batches of bounded
bytes. Each member is retried on its own at its offset, with a newly opened file; one
that stays unreadable becomes a row with an error instead of failing its neighbours.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

WIDTH = 576
PAD = b"\xff"
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL = struct.Struct("<4s5H3I2H")
SCHEMA = "archive string, member string, offset long, attempts int, error string, media binary, samples binary, content_bytes long, feature string"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("attempts", pa.int32()), ("error", pa.string()), ("media", pa.binary()), ("samples", pa.binary()), ("content_bytes", pa.int64()), ("feature", pa.string())])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG, WIDTH samples wide; the payload is whole rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad {kind!r} chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Rows, mean, deviation and an 8-bin histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x, minlength=256)
    v, n = np.arange(256), max(1, len(x))
    mean = int(bins @ v) / n
    return f"rows={len(x) // WIDTH} mean={mean:.4f} std={(max(0.0, int(bins @ (v * v)) / n - mean * mean)) ** 0.5:.4f} hist={','.join(map(str, bins.reshape(8, 32).sum(1)))}"


def write_archives(docs: DataFrame, text: str = "text", key: str = "doc_id", archive_bytes: int = 32 << 20) -> str:
    """Write all texts as members ``<key>.png`` and return the manifest's path.

    A text (null: empty) is its UTF-8 bytes and then bytes 255 up to a positive multiple
    of WIDTH. A task holds one archive of archive_bytes, or one member, at a time. Rows of one key
    are members of one name; a null key's member is ``None.png``. An empty table gives no archives.
    Other columns of docs are not looked at.
    """
    where = common.arrow_uri(docs.sparkSession, common.scratch(docs.sparkSession, "archives"))

    def run(batches):
        store, top = pafs.FileSystem.from_uri(where)
        store.create_dir(top, recursive=True)
        out, zipped, members = io.BytesIO(), None, 0

        def flush():
            zipped.close()
            name = f"{top}/{uuid.uuid4().hex}.zip"
            with store.open_output_stream(name) as f:
                f.write(out.getbuffer())
            return pa.RecordBatch.from_pylist([{"archive": name, "bytes": out.tell(), "members": members}])

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if zipped is None:
                    out, members = io.BytesIO(), 0
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                data = (x.as_py() or "").encode()
                data += PAD * (-len(data) % WIDTH or (0 if data else WIDTH))
                zipped.writestr(zipfile.ZipInfo(f"{k}.png"), to_png(data))
                members += 1
                if out.tell() >= archive_bytes:
                    yield flush()
                    zipped = None
        if zipped is not None:
            yield flush()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    path = common.scratch(docs.sparkSession, "manifest")
    rows.mapInArrow(run, "archive string, bytes long, members long").write.parquet(path)
    return f"{common.arrow_uri(docs.sparkSession, path)}#{where}"


class _Range(InputPartition):
    def __init__(self, archive: str, lo: int, hi: int):
        self.archive, self.lo, self.hi = archive, lo, hi


class MediaArchives(DataSource):
    """Options: manifest (a Parquet folder of archive and bytes) or path (a folder whose
    .zip files are the archives); store (a URI of the file system, else path's),
    split_bytes, batch_bytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.store = options.get("store") or options.get("path")
        self.manifest, self.path = options.get("manifest"), options.get("path")
        self.split, self.batch, self.retries = (int(options.get(k, v)) for k, v in (("split_bytes", 16 << 20), ("batch_bytes", 4 << 20), ("retries", 3)))

    def partitions(self) -> list[_Range]:
        """Byte ranges over all archives; nothing in them is read here."""
        if self.manifest:
            import pyarrow.parquet as pq

            store, path = pafs.FileSystem.from_uri(self.manifest)
            files = [x.path for x in store.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")]
            found = [(r["archive"], r["bytes"]) for f in sorted(files) for r in pq.read_table(f, columns=["archive", "bytes"], filesystem=store).to_pylist()]
        else:
            store, path = pafs.FileSystem.from_uri(self.path)
            found = [(x.path, x.size) for x in store.get_file_info(pafs.FileSelector(path, recursive=True)) if x.path.endswith(".zip")]
        return [_Range(a, lo, min(n, lo + self.split)) for a, n in sorted(found) for lo in range(0, n, self.split)] or [_Range("", 0, 0)]

    def open(self, archive: str):
        return pafs.FileSystem.from_uri(self.store)[0].open_input_file(archive)

    def member(self, file, info: zipfile.ZipInfo) -> bytes:
        """A stored member's bytes, read at its own offset and checked."""
        file.seek(info.header_offset)
        head = _LOCAL.unpack(file.read(_LOCAL.size))
        if head[0] != b"PK\x03\x04" or info.compress_type != zipfile.ZIP_STORED:
            raise ValueError("no stored member here")
        file.seek(info.header_offset + _LOCAL.size + head[9] + head[10])
        data = file.read(info.file_size)
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise ValueError("member is damaged")
        return data

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        rows, held, infos = [], 0, []
        for attempt in range(1, self.retries + 2):
            try:
                file = self.open(part.archive)
                infos = [x for x in zipfile.ZipFile(file).infolist() if part.lo <= x.header_offset < part.hi]
                break
            except Exception as e:
                told = {"archive": part.archive, "member": None, "offset": 0, "attempts": attempt, "error": f"{type(e).__name__}: {e}"}
                if attempt > self.retries and part.lo == 0:  # an archive without a directory is one row
                    rows.append(told)
        for info in sorted(infos, key=lambda x: x.header_offset):
            row = {"archive": part.archive, "member": info.filename, "offset": info.header_offset}
            for attempt in range(1, self.retries + 2):
                try:
                    media = self.member(file, info)
                    samples = from_png(media)
                    row |= {"attempts": attempt, "error": None, "media": media, "samples": samples, "content_bytes": len(samples.rstrip(PAD)), "feature": feature(samples)}
                    held += len(media) + len(samples)
                    break
                except Exception as e:
                    row |= {"attempts": attempt, "error": f"{type(e).__name__}: {e}"}
                    try:
                        file = self.open(part.archive)
                    except OSError as again:
                        row["error"] = f"{type(again).__name__}: {again}"
            rows.append(row)
            if held >= self.batch or len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_archives(spark: SparkSession, manifest: str, **options: str) -> DataFrame:
    """The members of the archives that write_archives made: a row each, with an error instead of
    samples where a member can't be read, and one row with an error and no member for an archive
    whose directory can't. An empty manifest gives no rows."""
    spark.dataSource.register(MediaArchives)
    path, _, store = manifest.partition("#")
    return spark.read.format("media_archives").options(manifest=path, store=store, **options).load()


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(common.table(spark, sf_dir, "documents"))
    return read_archives(spark, manifest).select(
        F.expr("try_cast(regexp_replace(member, '[.]png$', '') as bigint)").alias("doc_id"),
        F.col("content_bytes").alias("n_bytes"),  # UTF-8 has no byte 255, so all of them are padding
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "error",
    )


QUERIES = {"op2_media_columns": op2_media_columns}
ORACLE: dict[str, str] = {}
