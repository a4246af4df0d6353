"""Meetings end to end: entries and files as records, merged, linked, and the plan to write them.

A record: id, input (api or file), title, start (UTC), date_source, local_date, duration (seconds), host,
participants, emails, summary, steps, n_steps, url, segments: array<struct<start, speaker, text>>, notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import times as D
from ..session import written
from ..sources import payloads, transcripts
from . import matching, merge
from . import records as R
from .captures import filled, or_else

SEGMENTS = "array<struct<start:bigint,speaker:string,text:string>>"
FIELDS = ("id", "input", "title", "start", "date_source", "local_date", "duration", "host", "participants", "emails", "summary", "steps", "n_steps", "url", "segments", "notes")


def _none(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def id8(record_id: Column) -> Column:
    """Eight hex digits of an id for a file's name."""
    return F.when(F.startswith(record_id, F.lit("file-")), F.substring(record_id, 6, 8)).otherwise(F.substring(F.sha1(record_id), 1, 8))


def local_id(title: Column, key: Column) -> Column:
    slug = F.coalesce(F.nullif(T.slugify(title), F.lit("")), F.lit("untitled"))
    return F.concat(F.lit("file-"), F.substring(F.sha1(F.concat(slug, F.lit("|"), key)), 1, 12))


# --- entries -----------------------------------------------------------------------------


def entries(pages: DataFrame) -> DataFrame:
    """pages (page, text: JSON) -> (page, pos, entry: variant): the meetings of each page out of any
    envelopes; a page that is one meeting is its only entry; text that is no JSON gives none."""
    rows = pages.select("page", payloads.unwrap(F.col("text"), ("result", "content", "text")).alias("v"))
    listed = F.coalesce(F.try_variant_get("v", "$.meetings", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.when(payloads.is_object(F.col("v")), F.array("v")))
    return rows.select("page", F.posexplode(listed).alias("pos", "entry")).filter(payloads.is_object(F.col("entry")))


def summary_text(content: Column, overview: Column, details: Column, steps: Column) -> Column:
    """struct(summary, steps, n): a summary's content with its headings below the page's, its own next
    steps counted; else overview and details, an array<struct<label, text>>, and the steps given."""
    body = T.spine(F.coalesce(content, F.lit("")))
    counted = T.next_steps(body)
    given = F.filter(F.transform(F.coalesce(steps, _none()), lambda s: F.trim(s)), lambda s: s != "")
    parts = F.transform(
        F.filter(F.coalesce(details, _none("array<struct<label:string,text:string>>")), lambda d: filled(d["label"]) | filled(d["text"])),
        lambda d: F.concat(F.when(filled(d["label"]), F.concat(F.lit("### "), F.trim(d["label"]), F.lit("\n\n"))).otherwise(F.lit("")), F.trim(F.coalesce(d["text"], F.lit("")))),
    )
    plain = T.strip(F.array_join(F.concat(F.filter(F.array(F.trim(F.coalesce(overview, F.lit("")))), lambda x: x != ""), parts), "\n\n"))
    own = filled(F.trim(F.coalesce(content, F.lit(""))))
    kept = F.when(own & (counted > 0), _none()).otherwise(given)
    return F.struct(F.when(own, body).otherwise(plain).alias("summary"), kept.alias("steps"), F.when(own & (counted > 0), counted).otherwise(F.size(given)).cast("long").alias("n"))


#: The keys of an entry and of its summary that are texts.
TEXT_KEYS = (
    "start_time", "meeting_start_time", "summary_start_time", "end_time", "meeting_end_time", "summary_end_time", "summary_title", "topic", "meeting_topic", "title", "uuid", "meeting_uuid", "host_email", "meeting_host_email",
    "next_steps", "summary_content", "summary_overview", "share_url", "recording_url", "play_url", "duration", "transcript_vtt", "transcript",
)


def from_entries(rows: DataFrame, zone: str = "UTC", fallback: str = "Meeting") -> tuple[DataFrame, DataFrame]:
    """rows (page, pos, entry) -> (records, errors). An entry's keys win, its summary's fill gaps, and
    empty ones count as missing. A duration is end less start, else given minutes, else the end of the
    last cue. An entry without a usable start is an error (page, pos, error) and stops nothing."""
    raw = F.try_variant_get("entry", "$.summary", "variant")
    as_text = F.try_variant_get("entry", "$.summary", "string")
    rows = rows.withColumn("s", F.when(payloads.is_object(raw), raw).otherwise(F.try_parse_json(as_text)))
    rows = rows.withColumn("s", F.when(payloads.is_object(F.col("s")), F.col("s"))).withColumn("plain", F.when(F.col("s").isNull(), as_text))
    # all keys of a variant at once, and what is named more than once as a column
    texts = "struct<" + ",".join(f"{k}:string" for k in TEXT_KEYS) + ">"
    rows = rows.withColumns({"__entry": F.try_variant_get("entry", "$", texts), "__s": F.try_variant_get("s", "$", texts)})
    get = lambda *keys: F.coalesce(*[F.nullif(F.col(c)[k], F.lit("")) for k in keys for c in ("__entry", "__s")])
    sub = lambda key, kind: F.coalesce(F.try_variant_get("entry", f"$.{key}", kind), F.try_variant_get("s", f"$.{key}", kind))
    start, end = D.iso_utc(get("start_time", "meeting_start_time", "summary_start_time")), D.iso_utc(get("end_time", "meeting_end_time", "summary_end_time"))
    headline = F.trim(F.regexp_replace(F.regexp_replace(get("summary_title"), r"(?i)^\s*meeting summary for\s+", ""), r"\s*\(\d{1,2}/\d{1,2}/\d{4}\)\s*$", ""))
    title = F.coalesce(T.first_filled(get("topic", "meeting_topic", "title"), headline), F.lit(fallback))
    uuid = get("uuid", "meeting_uuid")
    person = "struct<name:string,user_name:string,display_name:string,email:string,user_email:string>"
    given = F.transform(F.coalesce(sub("participants", "array<variant>"), _none("array<variant>")), lambda p: F.struct(F.try_variant_get(p, "$", person).alias("o"), F.try_variant_get(p, "$", "string").alias("s")))
    mail = lambda p: F.coalesce(p["s"], F.lit("")).contains("@")
    rows = rows.withColumn("people", F.transform(given, lambda p: F.struct(
        T.first_filled(*[p["o"][k] for k in ("name", "user_name", "display_name")], F.when(p["o"].isNull() & ~mail(p), p["s"])).alias("name"),
        T.first_filled(*[p["o"][k] for k in ("email", "user_email")], F.when(p["o"].isNull() & mail(p), p["s"])).alias("email"),
    )))
    people = F.col("people")
    host = F.lower(F.coalesce(get("host_email", "meeting_host_email"), F.lit("")))
    names = F.array_distinct(F.filter(F.transform(people, lambda p: F.trim(p["name"])), filled))
    emails = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(host), F.transform(people, lambda p: F.lower(F.trim(p["email"])))), filled)))
    details = sub("summary_details", "array<struct<label:string,summary:string>>")
    edited = sub("edited_summary", "struct<next_steps:array<string>,summary_details:array<struct<label:string,summary:string>>>")
    steps = F.coalesce(edited["next_steps"], sub("next_steps", "array<string>"), F.when(get("next_steps").isNotNull(), F.array(get("next_steps"))))
    text = summary_text(F.coalesce(get("summary_content"), F.col("plain")), get("summary_overview"), F.transform(F.coalesce(edited["summary_details"], details), lambda d: F.struct(d["label"].alias("label"), d["summary"].alias("text"))), steps)
    rows = rows.withColumn("t", text)
    got = rows.select(
        "page", "pos", start.alias("start"), end.alias("end"), title.alias("title"), uuid.alias("uuid"), host.alias("host"), names.alias("participants"), emails.alias("emails"), "t",
        get("share_url", "recording_url", "play_url").alias("url"), get("duration").try_cast("long").alias("minutes"), get("transcript_vtt", "transcript").alias("vtt"),
    )
    # written once: filters on it would work out an entry's keys again, and its cues and itself each read the JSON
    got = written(got, "entries")
    bad = got.filter("start is null").select("page", "pos", F.lit("entry has no start_time").alias("error"))
    got = got.filter("start is not null").withColumn("id", F.coalesce("uuid", local_id(F.col("title"), F.date_format("start", "yyyy-MM-dd HH:mm"))))
    got = with_segments(got.withColumn("input", F.lit("api")).withColumn("date_source", F.lit("api")))
    span = F.unix_timestamp("end") - F.unix_timestamp("start")
    seconds = F.when(span > 0, span).otherwise(F.coalesce(F.col("minutes") * 60, F.col("cue_end"), F.lit(0))).cast("long")
    out = got.select(
        "id", "input", "title", "start", "date_source", F.to_date(F.coalesce(D.to_local(F.col("start"), zone), F.col("start"))).alias("local_date"), seconds.alias("duration"), "host",
        F.when(F.size("participants") > 0, F.col("participants")).otherwise(speakers(F.col("segments"))).alias("participants"), "emails", F.col("t.summary").alias("summary"), F.col("t.steps").alias("steps"),
        F.col("t.n").alias("n_steps"), F.coalesce("url", F.lit("")).alias("url"), "segments", F.lit("").alias("notes"),
    )
    return out, bad


def speakers(segments: Column) -> Column:
    """Who speaks, in order of appearance; unknown ones don't count."""
    return F.array_distinct(F.filter(F.transform(segments, lambda s: s["speaker"]), lambda x: filled(x) & (x != transcripts.UNKNOWN)))


def with_segments(rows: DataFrame, key: str = "id", text: str = "vtt") -> DataFrame:
    """rows with segments and cue_end out of a transcript's text, if it has any. Rows of one text
    share them."""
    files = rows.select(F.xxhash64(text).alias("__t"), F.col(text).alias("text")).filter("text is not null").distinct()
    cues = transcripts.any_text(files.select(F.col("__t").alias("id"), "text"))
    got = cues.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "start", "speaker", "text"))), lambda s: F.struct(s["start"].alias("start"), s["speaker"].alias("speaker"), s["text"].alias("text"))).alias("segments"), F.max("end").alias("cue_end"))
    # rows without a text share no key, or one task would have them all
    keyed = rows.withColumns({"__told": F.col(text).isNotNull(), "__t": F.when(F.col(text).isNull(), F.xxhash64(key)).otherwise(F.xxhash64(text))})
    return keyed.join(got.select(F.col("id").alias("__t"), F.lit(True).alias("__told"), "segments", "cue_end"), ["__t", "__told"], "left").drop("__t", "__told").withColumn("segments", F.coalesce(F.col("segments").cast(SEGMENTS), _none(SEGMENTS)))


# --- files -------------------------------------------------------------------------------

#: What names of meeting files look like.
NAME_GMT = r"GMT(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})"
NAME_FOLDER = r"^(\d{4})-(\d{2})-(\d{2}) (\d{2})\.(\d{2})\.(\d{2})\s*(.*?)(?:\s+(\d{9,12}))?\s*$"
NAME_ISO = r"[-_ ]?(\d{4})-(\d{2})-(\d{2})(?:[ T_]+(\d{2})[:.h-]?(\d{2}))?"
NAME_NOISE = r"(?i)[-_ ]*(meeting recording|recording|transcript|closed captions?|captions?)\s*$"
VARIANT = r"(?i)\.(transcript|cc)$"


def clean_title(c: Column) -> Column:
    """A file's name as a title: without what kind of file it is, underscores as blanks."""
    t = F.regexp_replace(F.regexp_replace(c, NAME_NOISE, ""), "_+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s*-\s*$|^\s*-\s*", ""), r"\s{2,}", " ")
    return F.trim(t, F.lit(" -_"))


def file_name(stem: Column, folder: Column, mtime: Column, zone: str = "UTC", fallback: str = "Meeting") -> Column:
    """struct(title, start, local_date, date_source, key) of a file by its name and folder (null for
    the export's own): a GMT stamp, the folder of a local recording, a date with or without a time, or
    else the file's own date."""
    digits = lambda c, p, n: F.concat_ws("-", *[F.regexp_extract(c, p, i) for i in (1, 2, 3)]) if n == 3 else F.concat(F.concat_ws("-", *[F.regexp_extract(c, p, i) for i in (1, 2, 3)]), F.lit(" "), F.concat_ws(":", *[F.regexp_extract(c, p, i) for i in range(4, n + 1)]))
    at = lambda c, p, n, f: F.try_to_timestamp(F.when(c.rlike(p), digits(c, p, n)), F.lit(f))
    base = F.regexp_replace(stem, VARIANT, "")
    gmt = at(base, NAME_GMT, 6, "yyyy-MM-dd HH:mm:ss")
    local = at(folder, NAME_FOLDER, 6, "yyyy-MM-dd HH:mm:ss")
    timed = at(base, NAME_ISO, 5, "yyyy-MM-dd HH:mm")
    day = F.to_date(at(base, NAME_ISO, 3, "yyyy-MM-dd"))
    folder_title = F.when(local.isNotNull(), F.trim(F.regexp_extract(folder, NAME_FOLDER, 7)))
    named = F.when(day.isNotNull(), clean_title(F.trim(F.concat_ws(" ", F.regexp_extract(base, f"^(.*?){NAME_ISO}", 1), F.regexp_replace(base, f"^.*?{NAME_ISO}", ""))))).otherwise(clean_title(base))
    source = F.when(gmt.isNotNull(), "filename-gmt").when(local.isNotNull(), "folder-name").when(day.isNotNull(), "filename").otherwise("file-mtime")
    start = F.coalesce(gmt, D.to_utc(F.coalesce(local, timed), zone))
    title = F.coalesce(F.when(gmt.isNotNull(), T.first_filled(folder_title, F.trim(folder), F.lit(fallback))).when(local.isNotNull(), T.first_filled(folder_title, clean_title(base))).otherwise(T.first_filled(named, clean_title(base))), F.lit(fallback))
    local_day = F.when(gmt.isNotNull(), F.to_date(F.coalesce(D.to_local(gmt, zone), gmt))).otherwise(F.coalesce(F.to_date(local), day, F.to_date(mtime)))
    key = F.when(start.isNotNull(), F.date_format(start, "yyyy-MM-dd HH:mm")).when(source == "file-mtime", base).otherwise(local_day.cast("string"))
    return F.struct(title.alias("title"), start.alias("start"), local_day.alias("local_date"), source.alias("date_source"), key.alias("key"))


def from_files(files: DataFrame, zone: str = "UTC", cursor: str | None = None) -> DataFrame:
    """files (path, folder, stem, mtime, vtt, notes) -> records. Files not changed since the cursor are
    left out; of files with one id (a transcript and captions of one meeting) the one with more
    segments stays, and the other's notes with it."""
    rows = files.filter(F.col("mtime") > F.lit(cursor).cast("timestamp")) if cursor else files
    rows = rows.withColumn("n", file_name(F.col("stem"), F.col("folder"), F.col("mtime"), zone))
    rows = with_segments(rows.withColumn("id", local_id(F.col("n.title"), F.col("n.key"))), "path")
    best = W.partitionBy("id").orderBy(F.desc(F.size("segments")), "path")
    rows = rows.withColumn("k", F.row_number().over(best)).withColumn("carried", F.first(F.nullif(F.trim("notes"), F.lit("")), ignorenulls=True).over(best.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).filter("k = 1")
    return rows.select(
        "id", F.lit("file").alias("input"), "n.title", "n.start", "n.date_source", "n.local_date", F.coalesce("cue_end", F.lit(0)).cast("long").alias("duration"), F.lit("").alias("host"), speakers(F.col("segments")).alias("participants"),
        _none().alias("emails"), F.lit("").alias("summary"), _none().alias("steps"), F.lit(0).cast("long").alias("n_steps"), F.lit("").alias("url"), "segments", F.coalesce("carried", F.lit("")).alias("notes"),
    )


# --- merging -----------------------------------------------------------------------------


def fill(records: DataFrame, order: str) -> DataFrame:
    """One record for each id: each field the first filled one in order, participants in order of
    appearance, addresses of all."""
    value = {c: F.size(c) > 0 if c in ("steps", "segments") else F.col(c) > 0 if c in ("duration", "n_steps") else F.col(c).isNotNull() if c in ("start", "local_date") else filled(F.col(c)) for c in FIELDS}
    pick = [F.coalesce(F.min_by(c, F.when(value[c], F.col(order))), F.min_by(c, order)).alias(c) for c in FIELDS if c not in ("id", "participants", "emails")]
    got = records.groupBy("id").agg(*pick, F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "participants"))), lambda x: x["participants"]))).alias("participants"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("emails")))).alias("emails"))
    return got.select(*FIELDS)


def merge_sources(api: DataFrame, files: DataFrame, order: str = "ordinal", minutes: int = 2) -> DataFrame:
    """Records of an interface (with ordinal) and of files (with ordinal) as one table: equal ids are
    one; a file that starts within so many minutes of a record still free is that record, which wins,
    and gives it its transcript, notes and duration where it has none."""
    one = fill(api, order)
    pairs = matching.greedy_pairs(files.selectExpr("id", "start", f"{order} as ordinal"), one.select("id", "start"), 60 * minutes, "string")
    side = files.join(pairs.selectExpr("left_id as id", "right_id"), "id")
    given = side.select(F.col("right_id").alias("id"), F.col("segments").alias("s2"), F.col("duration").alias("d2"), F.col("notes").alias("n2"))
    use = (F.size("segments") == 0) & (F.size(F.coalesce("s2", _none(SEGMENTS))) > 0)
    both = one.join(given, "id", "left").withColumns({
        "duration": F.when(use & (F.col("duration") == 0), F.col("d2")).otherwise(F.col("duration")), "notes": or_else(F.col("notes"), F.col("n2")),
        "segments": F.when(use, F.col("s2")).otherwise(F.col("segments")),
    })
    both = both.withColumn("participants", F.when(F.size("participants") > 0, F.col("participants")).otherwise(speakers(F.col("segments")))).select(*FIELDS)
    return both.unionByName(files.join(pairs.selectExpr("left_id as id"), "id", "left_anti").select(*FIELDS))


# --- calls -------------------------------------------------------------------------------


def call_records(calls: DataFrame) -> DataFrame:
    """calls (call: variant) -> records of a call interface with internal and external people, the
    content of its own (brief, points, next steps, outline) as summary. Calls without an id or a time
    are left out."""
    get = lambda *paths: payloads.first_of(F.col("call"), paths)
    call_id = get("$.metaData.id", "$.id", "$.callId")
    start = F.coalesce(D.iso_utc(get("$.metaData.started", "$.started")), D.iso_utc(get("$.metaData.scheduled", "$.scheduled")))
    party = "array<struct<emailAddress:string,email:string,name:string,speakerId:string,affiliation:string>>"
    people = F.coalesce(F.try_variant_get("call", "$.parties", party), _none(party))
    email = lambda p: F.lower(F.trim(or_else(p["emailAddress"], p["email"])))
    label = lambda p: or_else(F.trim(p["name"]), email(p))
    sided = lambda side: F.array_distinct(F.filter(F.transform(F.filter(people, lambda p: p["affiliation"] == side), label), filled))
    texts = lambda path, kind: F.filter(F.transform(F.coalesce(F.try_variant_get("call", path, kind), _none(kind)), lambda x: F.trim(x["text"])), filled)
    section = "array<struct<title:string,items:array<struct<text:string>>>>"
    marks = F.coalesce(F.try_variant_get("call", "$.content.highlights", section), _none(section))
    of = lambda keep: F.filter(F.flatten(F.transform(F.filter(marks, lambda s: keep(F.coalesce(s["title"], F.lit("")).rlike("(?i)next step|action item"))), lambda s: F.transform(F.coalesce(s["items"], _none("array<struct<text:string>>")), lambda i: F.trim(i["text"])))), filled)
    parts = F.coalesce(F.try_variant_get("call", "$.content.outline", "array<struct<section:string,startTime:bigint,items:array<struct<text:string>>>>"), _none("array<struct<section:string,startTime:bigint,items:array<struct<text:string>>>>"))
    outline = F.transform(parts, lambda s: F.struct(F.coalesce(F.nullif(F.trim(s["section"]), F.lit("")), F.lit("Section")).alias("section"), F.coalesce(s["startTime"], F.lit(0)).alias("start"), F.filter(F.transform(F.coalesce(s["items"], _none("array<struct<text:string>>")), lambda i: F.trim(i["text"])), filled).alias("items")))
    topic, tracker = "array<struct<name:string,duration:bigint>>", "array<struct<name:string,count:bigint>>"
    topics = F.array_distinct(F.filter(F.transform(F.filter(F.coalesce(F.try_variant_get("call", "$.content.topics", topic), _none(topic)), lambda t: F.coalesce(t["duration"], F.lit(1)) > 0), lambda t: F.trim(t["name"])), filled))
    trackers = F.transform(F.filter(F.coalesce(F.try_variant_get("call", "$.content.trackers", tracker), _none(tracker)), lambda t: filled(t["name"]) & (t["count"] > 0)), lambda t: F.concat(t["name"], F.lit(" ("), t["count"].cast("string"), F.lit(")")))
    context = "array<struct<objects:array<struct<objectType:string,fields:array<struct<name:string,value:string>>>>>>"
    objects = F.flatten(F.transform(F.coalesce(F.try_variant_get("call", "$.context", context), _none(context)), lambda c: c["objects"]))
    accounts = F.array_distinct(F.flatten(F.transform(F.filter(objects, lambda o: F.lower(o["objectType"]) == "account"), lambda o: F.transform(F.filter(o["fields"], lambda f: (F.lower(f["name"]) == "name") & filled(f["value"])), lambda f: F.trim(f["value"])))))
    rows = calls.select(
        outline.alias("outline"), topics.alias("topics"), trackers.alias("trackers"), F.coalesce(accounts, _none()).alias("accounts"), F.trim(F.coalesce(get("$.content.callOutcome.name"), F.lit(""))).alias("outcome"),
        call_id.alias("id"), start.alias("start"), F.coalesce(get("$.metaData.title", "$.title"), F.lit("(untitled call)")).alias("title"), get("$.metaData.duration", "$.duration").try_cast("long").alias("duration"), get("$.metaData.url", "$.url").alias("url"),
        F.coalesce(F.try_variant_get("call", "$.metaData.isPrivate", "boolean"), F.lit(False)).alias("private"), F.array_distinct(F.filter(F.transform(people, lambda p: F.trim(p["name"])), filled)).alias("participants"),
        F.array_sort(F.array_distinct(F.filter(F.transform(people, email), filled))).alias("emails"), sided("Internal").alias("internal"), sided("External").alias("external"),
        F.trim(F.coalesce(get("$.content.brief"), F.lit(""))).alias("brief"), texts("$.content.keyPoints", "array<struct<text:string>>").alias("points"), of(lambda x: ~x).alias("highlights"), of(lambda x: x).alias("steps"),
    )
    return rows.filter("id is not null and start is not null").withColumn("has_content", (F.col("brief") != "") | (F.size("points") > 0) | (F.size("outline") > 0) | (F.size("highlights") > 0) | (F.size("steps") > 0))


def call_segments(calls: DataFrame) -> DataFrame:
    """calls (id, monologues: variant, names: map of speaker ids) -> (id, pos, start, speaker, text): a row a
    monologue that says something, from its first sentence's second. Monologues may stand in a list,
    in a transcript, or in an answer with those of many calls."""
    kind = "array<struct<speakerId:string,sentences:array<struct<start:bigint,text:string>>>>"
    own = F.filter(F.try_variant_get("monologues", "$.callTranscripts", "array<variant>"), lambda t: F.try_variant_get(t, "$.callId", "string") == F.col("id"))
    whole = F.coalesce(F.try_variant_get("monologues", "$", kind), F.try_variant_get(F.try_element_at(own, F.lit(1)), "$.transcript", kind), F.try_variant_get("monologues", "$.transcript", kind))
    rows = calls.select("id", "names", F.posexplode(whole).alias("pos", "m"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("m.sentences", lambda s: F.coalesce(s["text"], F.lit(""))), " "), r"\s+", " "))
    start = F.floor(F.coalesce(F.try_element_at("m.sentences", F.lit(1))["start"], F.lit(0)) / 1000)
    return rows.select("id", "pos", start.alias("start"), F.coalesce(F.try_element_at("names", F.col("m.speakerId")), F.lit(transcripts.UNKNOWN)).alias("speaker"), text.alias("text")).filter("text <> ''")


def merge_calls(calls: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls (id, ordinal, transcript, ...), given (id, transcript) -> (one call an id: the later one, which
    never loses a transcript, with a given one before its own; the given ones that no call has)."""
    from .segments import later_wins

    one = later_wins(calls, "id", "ordinal", "transcript")
    named = given.groupBy("id").agg(F.max("transcript").alias("__t"))
    return one.join(named, "id", "left").withColumn("transcript", F.coalesce("__t", "transcript")).drop("__t"), named.join(one.select("id"), "id", "left_anti").withColumnRenamed("__t", "transcript")


def spoken_lines(files: DataFrame) -> DataFrame:
    """files (id, text: WebVTT) -> (id, pos, line): Name: text, consecutive cues of one speaker as one."""
    from .segments import speaker_islands

    return speaker_islands(transcripts.vtt(files)).select("id", F.col("island").alias("pos"), F.concat("speaker", F.lit(": "), "text").alias("line"))


def valid_name(c: Column) -> Column:
    """Whether a turn's speaker may be a name: six words at most, a letter first."""
    c = F.trim(c)
    return (c != "") & (F.size(F.split(c, r"\s+")) <= 6) & c.rlike(r"""(?U)^[\p{L}'"]""")


def is_call(value: Column) -> Column:
    """Whether a payload's object is a call: it has metadata, or parties and an id."""
    has = lambda k: F.try_variant_get(value, f"$.{k}", "variant").isNotNull()
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(value, "$.metaData", "variant")), F.lit("OBJECT")), F.lit(False)) | (has("parties") & (has("id") | has("callId")))


# --- the plan ----------------------------------------------------------------------------


def link_index(notes: DataFrame, keys: dict[str, str]) -> DataFrame:
    """notes (rel, stem, fm) of the raw layer, keys: folder -> frontmatter key of the id -> (source, id,
    start, note): what other meeting sources have, by the start in their frontmatter."""
    from ..sources import frontmatter as fm

    f, parts = F.col("fm"), []
    for folder, key in keys.items():
        start = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(F.coalesce(fm.scalar(f, "timestamp"), fm.scalar(f, "date")), r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})", 1), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
        rows = notes.filter(F.startswith("rel", F.lit(f"{folder}/")))
        parts.append(rows.select(F.lit(folder).alias("source"), fm.scalar(f, key).alias("id"), start.alias("start"), F.concat(F.lit("[["), "stem", F.lit("]]")).alias("note")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("id is not null and start is not null")


def ingest(records: DataFrame, others: DataFrame, existing: DataFrame, include: bool = False, minutes: int = 10) -> DataFrame:
    """The plan of a run: records with policy, included, links (source -> id of the nearest record
    within so many minutes), hash, file and action. others (source, id, start); existing (id, file,
    hash). Empty records are left out. An existing page is found by the whole id in its frontmatter, as among many
    records the eight digits in a name are those of several; a new title or start rewrites it in place, and an equal
    hash leaves it unchanged."""
    kept = records.filter(filled(F.col("summary")) | (F.size("segments") > 0) | filled(F.col("notes")))
    near = matching.nearest_within(kept.select("id", "start"), others, 60 * minutes)
    links = near.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", F.col("match").cast("string").alias("match"))))).alias("links"))
    p = R.transcript_policy(F.col("input"), filled(F.col("summary")), include, F.size("segments") > 0)
    spoken = F.transform("segments", lambda s: F.concat_ws("|", s["start"].cast("string"), s["speaker"], s["text"]))
    rows = kept.withColumn("p", p).select("*", "p.policy", "p.included").drop("p")
    stamp = F.substring(merge.content_hash(F.col("summary"), F.array_join("steps", "\n"), F.array_join(spoken, "\n"), F.col("notes"), F.concat_ws("|", "policy", F.col("included").cast("string"))), 1, 16)
    rows = rows.withColumn("hash", stamp).withColumn("id8", id8(F.col("id"))).join(links, "id", "left")
    old = existing.select("id", F.col("file").alias("__file"), F.col("hash").alias("__hash"))
    name = F.concat_ws("-", F.col("local_date").cast("string"), F.coalesce(F.nullif(T.slugify(F.col("title"), 60), F.lit("")), F.lit("meeting")), "id8")
    action = F.when(F.col("__hash").isNull(), "insert").when(F.col("__hash") == F.col("hash"), "unchanged").otherwise("update")
    return rows.join(old, "id", "left").withColumn("file", F.coalesce("__file", F.concat(name, F.lit(".md")))).withColumn("action", action).drop("__file", "__hash")


def transcript_text(segments: Column) -> Column:
    """Consecutive segments of one speaker as one paragraph: **Name** (hh:mm:ss) text."""
    state = F.struct(_none("array<struct<start:bigint,speaker:string,text:string>>").alias("done"))

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a["done"], F.lit(-1))
        same = last["speaker"].eqNullSafe(s["speaker"]) & last.isNotNull()
        joined = F.struct(last["start"].alias("start"), last["speaker"].alias("speaker"), F.concat_ws(" ", last["text"], s["text"]).alias("text"))
        return F.when(same, F.struct(F.array_append(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), joined).alias("done"))).otherwise(F.struct(F.array_append(a["done"], s).alias("done")))

    whole = F.aggregate(segments, state, step, lambda a: a["done"])
    return F.array_join(F.transform(whole, lambda s: F.concat(F.lit("**"), s["speaker"], F.lit("** ("), D.offset_text(s["start"]), F.lit(") "), s["text"])), "\n\n")


def page(plan: DataFrame, kind: str = "raw-meeting") -> Column:
    """A record's page: frontmatter, summary, next steps, the transcript or where it is, notes."""
    from .pages import frontmatter

    head = frontmatter(type=F.lit(kind), meeting_id=F.col("id"), title=F.col("title"), timestamp=F.date_format("start", "yyyy-MM-dd HH:mm:ss"), date=F.col("local_date").cast("string"), duration=D.duration(F.col("duration") / 60), transcript_policy=F.col("policy"), source_hash=F.col("hash"))
    part = lambda name, text: F.when(filled(text), F.concat(F.lit(f"## {name}\n\n"), text))
    pointer = F.when(F.col("policy") == "pointer", F.concat(F.lit("Not kept here."), F.when(filled(F.col("url")), F.concat(F.lit(" Recording: "), "url")).otherwise(F.lit(""))))
    steps = F.when(F.size("steps") > 0, F.concat(F.lit("- "), F.array_join("steps", "\n- ")))
    return F.concat(head, F.lit("\n"), F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), part("Summary", F.col("summary")), part("Next steps", steps), part("Transcript", F.coalesce(F.when(F.col("included"), transcript_text(F.col("segments"))), pointer)), part("Notes", F.col("notes"))), F.lit("\n"))
