"""JSON payloads, session logs, MIME bodies, replayed pages and file names as rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value: variant, error): one row a file; a malformed one is an error, no crash."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    value = F.try_parse_json("value")
    return files.select(F.col("_metadata.file_path").alias("path"), value.alias("value"), F.when(value.isNull(), "malformed JSON").alias("error"))


def first_of(value: Column, paths: Iterable[str], kind: str = "string") -> Column:
    """The first of several paths of a variant that is filled."""
    got = [F.try_variant_get(value, p, kind) for p in paths]
    return F.coalesce(*[F.nullif(g, F.lit("")) if kind == "string" else g for g in got])


def unwrap(text: Column, keys: Iterable[str] = ("result", "data", "content", "text", "body"), depth: int = 5) -> Column:
    """A variant out of envelopes that hold JSON as text, peeled depth times at most."""

    def peel(state: Column, _: Column) -> Column:
        value = state["value"]
        inner = F.coalesce(*[F.try_parse_json(F.try_variant_get(value, f"$.{k}", "string")) for k in keys], *[F.try_variant_get(value, f"$.{k}", "variant") for k in keys])
        holds = lambda x: is_object(x) | F.try_variant_get(x, "$", "array<variant>").isNotNull()
        found = T.let(inner, lambda x: F.struct(F.when(holds(x), x).otherwise(value).alias("value"), holds(x).alias("more")))
        return F.when(state["more"], found).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct(F.try_parse_json(text).alias("value"), F.lit(True).alias("more")), peel, lambda s: s["value"])


def is_object(value: Column) -> Column:
    """Whether a variant is an object: without the types of all that is in it, which schema_of_variant works out."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def records(pages: DataFrame, path: str, value: str = "value") -> DataFrame:
    """pages with record: one row an element of the array at path; pages without it give none."""
    return pages.withColumn("record", F.explode(F.try_variant_get(F.col(value), path, "array<variant>")))


#: The tools whose files a session touches.
FILE_TOOLS = ("Read", "Write", "Edit", "NotebookEdit")


def session_events(files: DataFrame) -> DataFrame:
    """files (session, text: JSON lines) -> (session, line, ts, role, text, file); bad lines are
    skipped. Content stands in the event or in its message, as a text or as parts."""
    rows = files.select("session", F.posexplode(F.split("text", "\n")).alias("line", "x")).select("session", F.col("line").cast("long").alias("line"), F.try_parse_json("x").alias("v"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    kind = F.coalesce(get("$.type"), F.lit(""))

    def content(path: str) -> Column:
        parts = F.transform(get(path, "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.startswith(F.schema_of_variant(p), F.lit("OBJECT")), F.lit("")).otherwise(F.try_variant_get(p, "$", "string"))))
        return F.nullif(F.coalesce(F.when(F.startswith(F.schema_of_variant(get(path, "variant")), F.lit("ARRAY")), F.array_join(parts, " ")), get(path)), F.lit(""))

    text = F.when(kind.isin("user", "assistant"), F.coalesce(content("$.content"), content("$.message.content"), F.lit(""))).when(kind == "last-prompt", F.coalesce(get("$.content"), F.lit("")))
    tool = kind.isin("tool-use", "tool_use") & first_of(F.col("v"), ["$.name", "$.tool_name"]).isin(*FILE_TOOLS)
    file = F.when(tool, first_of(F.col("v"), ["$.input.file_path", "$.input.path", "$.arguments.file_path", "$.arguments.path"]))
    return rows.filter("v is not null").select("session", "line", F.try_to_timestamp(get("$.timestamp")).alias("ts"), kind.alias("role"), text.alias("text"), file.alias("file"))


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder's session files; a session's id is its file's name."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    return session_events(files.select(F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"([^/]*)\.jsonl$", 1).alias("session"), F.col("value").alias("text")))


def base64url(c: Column) -> Column:
    """Text of a URL-safe base64 field; null where it isn't one."""
    plain = F.translate(c, "-_", "+/")
    return F.try_to_binary(F.rpad(plain, F.ceil(F.length(plain) / 4) * 4, "="), F.lit("base64")).cast("string")


def mime_body(decoded: Column, plain: Column, html: Column, snippet: Column, most: int = 50_000) -> Column:
    """The first filled of a decoded body, text/plain, text/html without tags, the snippet; past
    ``most`` characters, a mail record's own limit, it is cut and says so."""
    from ..functions.text import strip
    from .html import unescape

    cap = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n\n…[truncated]"))).otherwise(c)
    whole = [cap(strip(c)) for c in (unescape(decoded), plain, unescape(F.regexp_replace(html, "<[^>]+>", "")))]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (*whole, strip(unescape(snippet)))], F.lit(""))


def windows(start: str, end: str, days: int = 30) -> list[tuple[str, str]]:
    """A span of days cut for requests of so many days at most."""
    import datetime as dt

    a, z, out = dt.date.fromisoformat(start), dt.date.fromisoformat(end), []
    while a <= z:
        b = min(z, a + dt.timedelta(days=days - 1))
        out.append((a.isoformat(), b.isoformat()))
        a = b + dt.timedelta(days=1)
    return out


#: Pattern of a file's name, its time's format.
NAME_DATES = (
    (r"GMT(\d{8}-\d{6})", "yyyyMMdd-HHmmss", "name"),
    (r"(\d{4}-\d{2}-\d{2}[T _]\d{2}[.:-]?\d{2}[.:-]?\d{2})", "", "name"),
    (r"(\d{8}_\d{6})", "yyyyMMdd_HHmmss", "name"),
    (r"(\d{4}-\d{2}-\d{2} \d{2}[.]\d{2})", "yyyy-MM-dd HH.mm", "folder"),
    (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd", "day"),
)


def name_date(name: Column, mtime: Column) -> Column:
    """struct(start, date_source): a file's time by its name, else by its date of change."""
    out, label = [], F.lit(None).cast("string")
    for pattern, fmt, kind in reversed(NAME_DATES):
        found = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
        at = F.try_to_timestamp(found, F.lit(fmt)) if fmt else F.try_to_timestamp(F.concat(F.substring(found, 1, 10), F.lit(" "), F.regexp_replace(F.substring(found, 12, 8), r"[.:-]", "")), F.lit("yyyy-MM-dd HHmmss"))
        out.insert(0, at)
        label = F.when(at.isNotNull(), F.lit(kind)).otherwise(label)
    return F.struct(F.coalesce(*out, mtime).alias("start"), F.coalesce(label, F.lit("mtime")).alias("date_source"))


def sidecars(files: DataFrame, extensions: tuple[str, ...] = ("vtt", "txt", "md", "json")) -> DataFrame:
    """files (dir, stem, ext, path) -> (dir, stem, sidecar): the file of the same stem with the
    extension that comes first."""
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.lower("ext"))
    return files.withColumn("r", rank).filter("r > 0").groupBy("dir", "stem").agg(F.min(F.struct("r", "path"))["path"].alias("sidecar"))


def report_rows(report: Column) -> Column:
    """Rows of a patterns table in markdown: array of (slug, items, sources, first, latest)."""
    row = r"(?m)^\|\s*\d+\s*\|[^|]*\|\s*(\d{4}-\d{2}-\d{2})\s*\|\s*(\d{4}-\d{2}-\d{2})\s*\|\s*(\d+)\s*\|\s*([^|]*?)\s*\|\s*`([a-z0-9-]+)`\s*\|"
    names = ("first", "latest", "items", "sources", "slug")
    got = [F.regexp_extract_all(report, F.lit(row), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    return F.transform(F.arrays_zip(*got), lambda r: F.struct(r["slug"].alias("slug"), r["items"].cast("int").alias("items"), F.split(r["sources"], r",\s*").alias("sources"), r["first"].cast("date").alias("first"), r["latest"].cast("date").alias("latest")))
