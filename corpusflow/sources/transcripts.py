"""Transcripts and chat exports as (speaker, start, text) rows, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import times as D

UNKNOWN = "Unknown speaker"
_CUE = r"(?ms)^\s*(?:(?:\d+:)?\d+:\d+)[.,]\d+\s+-->\s+[^\n]*\n.*?(?=^\s*$|\z)"


def _spoken(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " "))


def vtt(files: DataFrame) -> DataFrame:
    """files (id, text) -> (id, pos, start, end, speaker, text), a row a voice of each cue.

    ``<v Name>`` gives the speaker; else ``Name: text`` with a name of six words and 60
    characters at most; else the speaker is unknown."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    cues = files.select("id", F.posexplode(F.regexp_extract_all(text, F.lit(_CUE), F.lit(0))).alias("cue", "c"))
    clock = lambda n: D.clock_seconds(F.regexp_extract("c", r"((?:\d+:)?\d+:\d+)[.,]\d+\s+-->\s+((?:\d+:)?\d+:\d+)", n))
    body = F.regexp_replace("c", r"(?s)^\s*[^\n]*-->[^\n]*\n", "")
    cues = cues.select("id", "cue", clock(1).alias("start"), clock(2).alias("end"), body.alias("body"))
    voice = r"(?s)<v(?:\.[^\s>]*)?\s+([^>]+)>(.*?)(?=</v>|<v[\s.]|\z)"
    names, said = (F.regexp_extract_all("body", F.lit(voice), F.lit(i)) for i in (1, 2))
    plain = _spoken(F.col("body"))
    name = F.substring_index(plain, ": ", 1)
    named = plain.contains(": ") & (F.length(name) <= 60) & (F.size(F.split(name, " ")) <= 6)
    one = F.struct(F.when(named, F.trim(name)).otherwise(F.lit(UNKNOWN)).alias("s"), F.when(named, F.trim(F.regexp_replace(plain, r"^.*?: ", ""))).otherwise(plain).alias("t"))
    rows = F.when(F.size(names) > 0, F.zip_with(names, said, lambda s, t: F.struct(F.trim(s).alias("s"), _spoken(t).alias("t")))).otherwise(F.array(one))
    out = cues.select("id", "cue", "start", "end", F.posexplode(F.filter(rows, lambda x: x["t"] != "")).alias("k", "x"))
    order = W.partitionBy("id").orderBy("cue", "k")
    return out.select("id", (F.row_number().over(order) - 1).alias("pos"), "start", "end", F.col("x.s").alias("speaker"), F.col("x.t").alias("text"))


def vtt_duration(files: DataFrame) -> DataFrame:
    """(id, seconds): the end of the last cue."""
    return vtt(files).groupBy("id").agg(F.max("end").alias("seconds"))


def plain(files: DataFrame) -> DataFrame:
    """files (id, text) without cues -> (id, pos, start, end, speaker, text), a row a line: Name: text with
    a name of six words and 60 characters at most, else an unknown speaker; all at the start."""
    line = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    rows = files.select("id", F.posexplode(F.filter(F.transform(line, lambda x: F.trim(x)), lambda x: (x != "") & (F.upper(x) != "WEBVTT"))).alias("pos", "x"))
    name = F.substring_index("x", ": ", 1)
    rest = F.trim(F.regexp_replace("x", r"^.*?: ", ""))
    named = F.contains("x", F.lit(": ")) & (rest != "") & (F.length(name) <= 60) & (F.size(F.split(F.trim(name), r"\s+")) <= 6)
    zero = F.lit(0).cast("long")
    return rows.select("id", "pos", zero.alias("start"), zero.alias("end"), F.when(named, F.trim(name)).otherwise(F.lit(UNKNOWN)).alias("speaker"), F.when(named, rest).otherwise(F.col("x")).alias("text"))


def any_text(files: DataFrame) -> DataFrame:
    """files (id, text) -> (id, pos, start, end, speaker, text): WebVTT where there are cues, else lines."""
    cued = F.contains("text", F.lit("-->"))
    return vtt(files.filter(cued)).unionByName(plain(files.filter(~cued & (F.trim("text") != ""))))


#: The shapes of a turn's first line in a transcript pasted as text.
TURNS = (
    r"^\[?((?:\d+:)?\d+:\d{2})\]?\s*[-–|]?\s*([^:\n]{1,60}):\s*(.*)$",
    r"^([^:\n\d\[]{1,60}?)\s*[\[(]((?:\d+:)?\d+:\d{2})[\])]:?\s*(.*)$",
    r"^((?:\d+:)?\d+:\d{2})\s*\|\s*([^\n|]{1,60})(.*)$",
    r"^([^:\n\d\[]{1,60}?)\s+((?:\d+:)?\d+:\d{2})\s*()$",
    r"^()([A-Z][^:\n]{0,59}):\s+(.*)$",
)


def turns(files: DataFrame) -> DataFrame:
    """files (id, text) -> (id, turn, start, speaker, text): a line in one of TURNS' shapes
    begins a turn and the lines that follow belong to it; a text without any is one turn."""
    lines = files.select("id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")).alias("line", "x")).withColumn("x", F.trim("x"))
    time_first = (True, False, True, False, True)
    shape = F.coalesce(*[F.when(F.col("x").rlike(p), F.lit(i)) for i, p in enumerate(TURNS)])
    pick = lambda g: F.coalesce(*[F.when(F.col("shape") == i, F.regexp_extract("x", p, g(i))) for i, p in enumerate(TURNS)])
    rows = lines.withColumn("shape", shape).withColumn("at", pick(lambda i: 1 if time_first[i] else 2)).withColumn("who", pick(lambda i: 2 if time_first[i] else 1)).withColumn("rest", pick(lambda _: 3))
    rows = rows.withColumn("turn", F.sum(F.when(F.col("shape").isNotNull(), 1).otherwise(0)).over(W.partitionBy("id").orderBy("line")))
    said = F.when(F.col("shape").isNull(), F.col("x")).otherwise(F.trim("rest"))
    got = rows.groupBy("id", "turn").agg(
        F.max(F.when(F.col("shape").isNotNull(), F.trim("who"))).alias("speaker"), F.max(F.when(F.col("at") != "", D.clock_seconds(F.col("at")))).alias("start"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line", said.alias("t")))), lambda p: p["t"] != ""), lambda p: p["t"]), " ").alias("text"),
    )
    return got.filter("text <> '' or speaker is not null").select("id", "turn", "start", F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker"), "text")


_BLOCK = r"(?s)=== Message (?:from (.*?) \(([^)]+)\) )?at (.+?) ===\s*\nMessage TS: (\S+)\n(.*?)(?=\n=== Message |\z)"
_MENTION = r"^\s*<@([UWB][A-Z0-9]+)\|([^>]+)>"


def chat(files: DataFrame) -> DataFrame:
    """files (id, text) -> (id, pos, ts, sender_id, sender, text), a row a message block.

    A header without a sender gives way to a mention at the text's start; else the sender
    is unknown. A sender with an id and no name keeps an empty name."""
    part = [F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(i)) for i in (1, 2, 4, 5)]
    rows = files.select("id", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(part, ("name", "uid", "ts", "body"), strict=True)])).alias("pos", "m"))
    body = F.trim(F.regexp_replace("m.body", r"^\s+|\s+$", ""))
    rows = rows.select("id", "pos", F.col("m.ts").alias("ts"), F.coalesce("m.uid", F.lit("")).alias("uid"), F.trim(F.coalesce("m.name", F.lit(""))).alias("name"), body.alias("text"))
    bare = F.col("uid") == ""
    mention = F.col("text").rlike(_MENTION)
    return rows.select(
        "id", "pos", "ts",
        F.when(bare & mention, F.regexp_extract("text", _MENTION, 1)).otherwise(F.trim("uid")).alias("sender_id"),
        F.when(~bare, F.col("name")).when(mention, F.regexp_extract("text", _MENTION, 2)).otherwise("unknown").alias("sender"), "text",
    )


def tabs(files: DataFrame, pattern: str = r"^# (.+)$") -> DataFrame:
    """files (id, text) -> (id, tab, title, body): a document's parts at first-level headings,
    vertical tabs as line feeds; what stands before the first has title null."""
    text = F.replace("text", F.lit("\u000b"), F.lit("\n"))
    lines = files.select("id", F.posexplode(F.split(text, "\n")).alias("line", "x"))
    head = F.col("x").rlike(pattern)
    rows = lines.withColumn("tab", F.sum(F.when(head, 1).otherwise(0)).over(W.partitionBy("id").orderBy("line")))
    got = rows.groupBy("id", "tab").agg(
        F.max(F.when(head, F.trim(F.regexp_extract("x", pattern, 1)))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("line", "x")))), lambda p: p["x"]), "\n").alias("body"),
    )
    return got.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).filter("title is not null or body <> ''")


def ndjson(files: DataFrame) -> DataFrame:
    """files (id, source, text: JSON lines) -> (id, source, line, speaker_id, name, start, text) of each id's
    preferred source that says something: refined before live. Headers (meta), blank texts and lines that
    are no JSON are left out."""
    rows = files.select("id", "source", F.posexplode(F.split("text", "\n")).alias("line", "x")).withColumn("v", F.try_parse_json("x"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    rows = rows.select("id", "source", "line", get("$.speaker.id").alias("speaker_id"), F.nullif(F.trim(get("$.speaker.name")), F.lit("")).alias("name"), get("$.speaker.source").alias("side"), get("$.start", "double").alias("start"), F.trim(get("$.text")).alias("text"))
    return prefer(rows.filter("text <> ''"), "id", "source", ["refined", "live"])


def speaker_label(speaker_id: Column, name: Column, side: Column) -> Column:
    """A segment's own name, else Speaker n: ids from 1000 on are the far side's."""
    n = speaker_id.try_cast("long")
    return F.coalesce(name, F.when(n >= 1000, F.format_string("Speaker %d (remote)", n - 999)).when(side == "mic", F.concat(F.lit("Speaker "), speaker_id, F.lit(" (mic)"))), F.concat(F.lit("Speaker "), speaker_id), F.lit("Speaker ?"))


def speaker_map(c: Column) -> Column:
    """A speaker map's JSON as id -> name: of each assignment the person by consensus, the user, the
    microphone or the model, in this order."""
    v = F.try_parse_json(c)
    people = F.coalesce(F.try_variant_get(v, "$.people", "map<string, struct<name:string>>"), F.create_map().cast("map<string, struct<name:string>>"))
    given = F.coalesce(F.try_variant_get(v, "$.assignments", "map<string, struct<consensus:string,user:string,mic:string,llm:string>>"), F.create_map().cast("map<string, struct<consensus:string,user:string,mic:string,llm:string>>"))
    who = lambda _, a: F.trim(F.try_element_at(people, F.coalesce(*[F.nullif(a[k], F.lit("")) for k in ("consensus", "user", "mic", "llm")], F.lit("")))["name"])
    return F.map_filter(F.transform_values(given, who), lambda _, n: F.coalesce(n, F.lit("")) != "")


def prefer(rows: DataFrame, key: str, source: str, order: list[str]) -> DataFrame:
    """The rows of each key's preferred source: the first of order that it has."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(source))
    return rows.withColumn("__r", rank).withColumn("__b", F.min("__r").over(W.partitionBy(key))).filter("__r = __b").drop("__r", "__b")
