"""Custom data sources: SQLite files, paged APIs (replayed from files), DOCX transcripts."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = {"INT": "long", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def introspect(path: str, table: str | None = None, needles: tuple[str, ...] = ("DATE", "PATH")) -> tuple[str, list[tuple[str, str]]]:
    """A table and its columns: the one named, else the largest whose columns' names hold
    every needle."""
    with _connect(path) as db:
        names = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' order by name")]
        found = {n: [(r[1], next((t for k, t in _TYPES.items() if k in (r[2] or "").upper()), "string")) for r in db.execute(f"pragma table_info({_quote(n)})")] for n in names}
        if table:
            if table not in found:
                raise ValueError(f"no table {table} in {path}")
            return table, found[table]
        fits = [n for n, cols in found.items() if all(any(x in c.upper() for c, _ in cols) for x in needles)]
        if not fits:
            raise ValueError(f"no table with columns like {', '.join(needles)} in {path}")
        largest = max(fits, key=lambda n: (db.execute(f"select count(*) from {_quote(n)}").fetchone()[0], n))
        return largest, found[largest]


def discover(roots: list[str], name: str) -> str | None:
    """The first file of that name at a root or below it, roots in order; those of a root by path.
    A root that can't be read is passed over."""
    from pathlib import Path

    for root in map(Path, roots):
        try:
            found = [root] if root.name == name and root.is_file() else sorted(p for p in root.rglob(name) if p.is_file())
        except OSError:
            continue
        if found:
            return str(found[0])
    return None


class SqliteSource(DataSource):
    """Format ``sqlite_file``: path, table (or needles, by which one is found), partitions,
    where (a predicate for SQLite itself). Rowid ranges are the partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> str:
        needles = tuple(self.options.get("needles", "DATE,PATH").split(","))
        _, columns = introspect(self.options["path"], self.options.get("table"), needles)
        return ", ".join(f"`{c}` {t}" for c, t in columns)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, [(f.name, f.dataType.simpleString()) for f in schema.fields])


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[tuple[str, str]]):
        self.path, self.columns = options["path"], columns
        self.table = introspect(self.path, options.get("table"), tuple(options.get("needles", "DATE,PATH").split(",")))[0]
        self.n, self.where = int(options.get("partitions", 4)), options.get("where")

    def partitions(self) -> list[_Rows]:
        with _connect(self.path) as db:
            lo, hi = db.execute(f"select min(rowid), max(rowid) from {_quote(self.table)}").fetchone()
        if lo is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(hi - lo + 1) // self.n))
        return [_Rows(a, min(hi + 1, a + step)) for a in range(lo, hi + 1, step)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        names = ", ".join(_quote(c) for c, _ in self.columns)
        where = "rowid >= ? and rowid < ?" + (f" and ({self.where})" if self.where else "")
        as_kind = {"bigint": int, "double": float, "string": str, "binary": bytes}
        with _connect(self.path) as db:
            for row in db.execute(f"select {names} from {_quote(self.table)} where {where}", (part.lo, part.hi)):
                yield tuple(None if v is None else as_kind.get(t, str)(v) for v, (_, t) in zip(row, self.columns, strict=True))


def sqlite(spark: SparkSession, path: str, table: str | None = None, where: list[tuple[str, str, object]] | None = None, **options: str) -> DataFrame:
    """A SQLite table; where: (column, comparison, value) that SQLite itself decides, by its indexes.

    The format does not take Spark's own filters: Spark 4.1 keeps what a Python source was given with the
    frame, so that a second query of the frame without the filter misses rows."""
    register(spark)
    parts = []
    for column, sign, value in where or []:
        if sign not in ("=", "<>", "<", "<=", ">", ">="):
            raise ValueError(f"no comparison: {sign}")
        text = "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(float(value)) if isinstance(value, float) else str(int(value))
        parts.append(f"{_quote(column)} {sign} {text}")
    given = {"path": path, **({"table": table} if table else {}), **({"where": " and ".join(parts)} if parts else {}), **options}
    return spark.read.format("sqlite_file").options(**given).load()


def register(spark: SparkSession) -> None:
    """Make the formats of this module known."""
    for source in (SqliteSource, ReplaySource):
        spark.dataSource.register(source)


# --- paged APIs ------------------------------------------------------------------------


def paged(fetch: Callable[[dict], tuple[int, dict]], query: dict, items: str, cursor: str, spacing: float = 0.35, retries: int = 3, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """All items of a paged request. fetch answers (status, payload); 404 is empty, 429 and
    5xx are tried again after the wait that the payload names, at most ``wait`` seconds."""
    at: dict = dict(query)
    while True:
        for attempt in range(retries + 1):
            status, payload = fetch(at)
            if status == 404:
                return
            if status < 400:
                break
            if attempt == retries or (status != 429 and status < 500):
                raise OSError(f"request failed with {status}")
            sleep(min(wait, float(payload.get("retry_after", 2**attempt))))
        yield from payload.get(items) or []
        if not payload.get(cursor):
            return
        at = {**query, cursor: payload[cursor]}
        sleep(spacing)


class ReplaySource(DataSource):
    """Format ``replayed_pages``: pages of an API kept as JSON files, page_<n>.json in a
    folder for each request; a partition a request. Gives (request, item as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "replayed_pages"

    def schema(self) -> str:
        return "request string, item string"

    def reader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)


class _Request(InputPartition):
    def __init__(self, name: str):
        self.name = name


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.items, self.cursor = options["path"], options.get("items", "items"), options.get("cursor", "next_page_token")

    def partitions(self) -> list[_Request]:
        from pathlib import Path

        return [_Request(p.name) for p in sorted(Path(self.path).iterdir()) if p.is_dir()]

    def read(self, part: _Request) -> Iterator[tuple]:
        from pathlib import Path

        def fetch(query: dict) -> tuple[int, dict]:
            file = Path(self.path, part.name, f"page_{query.get(self.cursor, 0)}.json")
            return (200, json.loads(file.read_text())) if file.exists() else (404, {})

        for item in paged(fetch, {}, self.items, self.cursor, spacing=0):
            yield part.name, json.dumps(item, sort_keys=True)


# --- DOCX ------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TURN = re.compile(r"^(?P<who>[^\t\n]{1,60}?)(?:\t|\s{2,}|\s)(?P<at>(?:\d+:)?\d{1,2}:\d{2})\s*$")
_NOTICE = re.compile(r"(started|stopped) transcription\s*$")


def docx_paragraphs(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        out.append("".join({f"{_W}t": x.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, "") for x in p.iter()))
    return out


def parse_docx(data: bytes) -> dict:
    """title, date and duration lines, and turns (speaker, start in seconds, text) of a
    transcript; a turn begins at "name time", and notices of the recorder are left out."""
    lines = [x.strip("\n") for p in docx_paragraphs(data) for x in p.split("\n")]
    head: list[str] = []
    turns: list[dict] = []
    for line in lines:
        if not line.strip() or _NOTICE.search(line):
            continue
        m = _TURN.match(line.strip())
        if m:
            seconds = 0
            for part in m["at"].split(":"):
                seconds = seconds * 60 + int(part)
            turns.append({"speaker": m["who"].strip(), "start": seconds, "text": ""})
        elif turns:
            turns[-1]["text"] = f"{turns[-1]['text']} {line.strip()}".strip()
        else:
            head.append(line.strip())
    return {"title": head[0] if head else None, "date": head[1] if len(head) > 1 else None, "duration": head[2] if len(head) > 2 else None, "turns": [t for t in turns if t["text"]]}


DOCX_SCHEMA = "path string, title string, date string, duration string, turns array<struct<speaker:string,start:int,text:string>>, error string"


def docx(spark: SparkSession, path: str) -> DataFrame:
    """One row a DOCX file; an unreadable one has an error. A zip of XML has no SQL form, so
    files go through Arrow batches."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"path": name, **parse_docx(data), "error": None})
                except Exception as e:
                    rows.append({"path": name, "title": None, "date": None, "duration": None, "turns": [], "error": f"{type(e).__name__}: {e}"})
            kind = pa.schema([("path", pa.string()), ("title", pa.string()), ("date", pa.string()), ("duration", pa.string()), ("turns", pa.list_(pa.struct([("speaker", pa.string()), ("start", pa.int32()), ("text", pa.string())]))), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path"), F.col("content")).mapInArrow(run, DOCX_SCHEMA)


def rules_frame(spark: SparkSession, text: str, strict: bool = False) -> DataFrame:
    """A list of rules in small YAML, "- key: value" items with further indented keys, as a
    frame of strings. strict: a line that fits no shape is an error."""
    items: list[dict[str, str]] = []
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.split(" #", 1)[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or re.match(r"^\w+:\s*$", line):
            continue
        m = re.match(r"^(\s*-\s+|\s+)?(\w+):\s*(.*)$", line)
        if not m or (not items and not (m[1] or "").strip()):
            if strict:
                raise ValueError(f"line {n} is no rule: {raw!r}")
            continue
        if (m[1] or "").strip() == "-":
            items.append({})
        items[-1][m[2]] = m[3].strip().strip("'\"")
    keys = sorted({k for i in items for k in i})
    return spark.createDataFrame(pd.DataFrame([{k: i.get(k) for k in keys} for i in items]) if items else [], None if items else "key string")
