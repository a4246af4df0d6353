"""Meeting documents with tabs: full notes, quick notes and a transcript as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions import times as D

#: How lines of boilerplate begin, and a document's name.
FOOTERS = (
    "*You should review Gemini's notes",
    "*How is the quality of",
    "We've **updated the",
    "Let us know what you think",
    "**Want to see more?",
    "*Please ****rate",
    "*This editable transcript was computer generated",
)
NAME_SUFFIX = "Notes by Gemini"
NAME = r"^(.*?)\s*-\s*(\d{4}/\d{2}/\d{2})\s+(\d{1,2}:\d{2})\s*([A-Za-z]{1,5})?\s*-\s*Notes by Gemini\s*$"


def document_name(c: Column, zone: str) -> Column:
    """struct(title, local, zone, utc): of a name that holds them; else the title alone."""
    name = F.regexp_replace(F.trim(c), r"(?i)\.md$", "")
    part = lambda i: F.regexp_extract(name, NAME, i)
    fits = name.rlike(NAME)
    local = F.try_to_timestamp(F.when(fits, F.concat(F.replace(part(2), F.lit("/"), F.lit("-")), F.lit(" "), F.lpad(part(3), 5, "0"))), F.lit("yyyy-MM-dd HH:mm"))
    bare = F.trim(F.regexp_replace(name, rf"(?i)\s*-\s*{NAME_SUFFIX}\s*$", ""))
    title = F.coalesce(F.nullif(F.when(fits, F.trim(part(1))).otherwise(bare), F.lit("")), F.lit("(untitled meeting)"))
    ahead = D.offset_minutes(F.nullif(part(4), F.lit("")), local, zone)
    return F.struct(title.alias("title"), local.alias("local"), F.upper(part(4)).alias("zone"), F.timestamp_seconds(F.unix_timestamp(local) - ahead * 60).alias("utc"))


def tabs(files: DataFrame) -> DataFrame:
    """files (id, text) -> (id, tab, name, kind, line, x): the lines of each tab. Tabs begin at
    first-level headings; a text before the first, or without any, is the full notes. Vertical tabs
    are line feeds; boilerplate lines are left out."""
    text = F.regexp_replace(F.replace("text", F.lit("\u000b"), F.lit("\n")), r"\r\n?", "\n")
    lines = files.select("id", F.posexplode(F.split(text, "\n")).alias("line", "x"))
    head = F.startswith("x", F.lit("# "))
    order = W.partitionBy("id").orderBy("line")  # a document is one row of the input
    lines = lines.withColumn("tab", F.sum(head.cast("int")).over(order)).withColumn("name", F.coalesce(F.last(F.when(head, F.trim(F.substring("x", 3, 1 << 20))), ignorenulls=True).over(order), F.lit("Full notes")))
    low = F.lower("name")
    kind = F.when(low.contains("transcript"), "transcript").when(low.contains("quick"), "quick").otherwise("full")
    footer = F.lit(False)
    for f in FOOTERS:
        footer |= F.startswith(F.trim("x"), F.lit(f))
    return lines.filter(~head & ~footer).withColumn("kind", kind)


def _body(rows: DataFrame, *keys: str) -> DataFrame:
    """Lines of each group as one text, blank runs as one blank line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tab", "line", "x"))), lambda r: r["x"]), "\n")
    return rows.groupBy(*keys).agg(F.min(F.struct("tab", "line")).alias("at"), T.strip(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("body")).filter("body <> ''")


def sections(lines: DataFrame) -> DataFrame:
    """(id, section, body) of full tabs: third-level headings; second-level ones inside a section are
    parts of it. Sections of one name are one."""
    rows = lines.filter("kind = 'full'").withColumn("x", F.regexp_replace("x", r"\s+$", ""))
    head = F.startswith("x", F.lit("### "))
    order = W.partitionBy("id", "tab").orderBy("line")
    rows = rows.withColumn("section", F.last(F.when(head, F.trim(F.substring("x", 5, 1 << 20))), ignorenulls=True).over(order)).filter(~head & F.col("section").isNotNull())
    rows = rows.withColumn("x", F.when(F.startswith("x", F.lit("## ")), F.concat(F.lit("### "), F.trim(F.substring("x", 4, 1 << 20)))).otherwise(F.col("x")))
    return _body(rows, "id", "section").select("id", "section", "body")


def topics(lines: DataFrame) -> DataFrame:
    """(id, topic, body) of quick tabs, at second- and third-level headings after the tab's title."""
    rows = lines.filter("kind = 'quick'").withColumn("x", F.regexp_replace("x", r"\s+$", ""))
    head = F.col("x").rlike(r"^##{1,2} ")
    order = W.partitionBy("id", "tab").orderBy("line")
    rows = rows.withColumn("n", F.sum(head.cast("int")).over(order)).withColumn("topic", F.last(F.when(head, F.trim(F.ltrim(F.col("x"), F.lit("#")))), ignorenulls=True).over(order))
    return _body(rows.filter(~head & F.col("topic").isNotNull()), "id", "tab", "n", "topic").select("id", "topic", "body")


def transcript(lines: DataFrame) -> DataFrame:
    """(id, line, start, speaker, text) of transcript tabs: **Name:** lines, each with the time of the
    heading before it."""
    rows = lines.filter("kind = 'transcript'").withColumn("x", F.regexp_replace("x", r"\s+$", ""))
    order = W.partitionBy("id", "tab").orderBy("line")
    clock = F.nullif(F.regexp_extract("x", r"^###\s+(\d{2}:\d{2}:\d{2})\s*$", 1), F.lit(""))
    said = r"^\*\*([^*]+?):\s*\*\*\s*(.*)$"
    rows = rows.withColumn("start", F.coalesce(D.clock_seconds(F.last(clock, ignorenulls=True).over(order)), F.lit(0)))
    return rows.filter(F.col("x").rlike(said)).select("id", "line", F.col("start").cast("long").alias("start"), F.trim(F.regexp_extract("x", said, 1)).alias("speaker"), F.trim(F.regexp_extract("x", said, 2)).alias("text")).filter("text <> ''")


def headers(lines: DataFrame) -> DataFrame:
    """(id, date, title, participants, emails, attachments, transcript_url, steps): what stands before
    the sections. Steps: check boxes of the next steps."""
    rows = lines.filter("kind <> 'transcript'").withColumn("x", F.trim("x")).filter("x <> ''")
    order = W.partitionBy("id", "tab").orderBy("line")
    # a tab's header ends at its first section: a third-level heading, or a second title
    ends = F.startswith("x", F.lit("### ")) | (F.startswith("x", F.lit("## ")) & (F.sum(F.startswith("x", F.lit("## ")).cast("int")).over(order) > 1))
    rows = rows.withColumn("past", F.max(ends.cast("int")).over(order)).filter("past = 0")
    mail, link = r"\[([^\]]*)\]\(mailto:([^)]+)\)", r"\[([^\]]*)\]\(([^)]+)\)"
    pairs = lambda p: F.arrays_zip(F.regexp_extract_all("x", F.lit(p), F.lit(1)).alias("label"), F.regexp_extract_all("x", F.lit(p), F.lit(2)).alias("url"))
    invited = F.when(F.startswith("x", F.lit("Invited ")) | (F.col("x").rlike(mail) & ~F.startswith("x", F.lit("-"))), pairs(mail))
    files = F.when(F.startswith("x", F.lit("Attachments")) | F.startswith("x", F.lit("Meeting records")), pairs(link))
    rank = F.struct(F.when(F.col("kind") == "full", 0).otherwise(1).alias("k"), "tab", "line")
    got = rows.groupBy("id").agg(
        F.min_by(T.month_line(F.col("x")), F.when(T.month_line(F.col("x")).isNotNull(), rank)).alias("date"),
        F.min_by(F.trim(F.substring("x", 4, 1 << 20)), F.when(F.startswith("x", F.lit("## ")), rank)).alias("title"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(invited.isNotNull(), F.struct(rank.alias("r"), invited.alias("v"))))), lambda x: x["v"])).alias("invited"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(files.isNotNull(), F.struct(rank.alias("r"), files.alias("v"))))), lambda x: x["v"])).alias("files"),
    )
    keep = lambda c: F.array_distinct(F.filter(c, lambda x: x != ""))
    is_transcript = lambda f: F.lower(f["label"]).contains("transcript")
    box = F.col("x").rlike(r"^- \[")
    section = F.last(F.when(F.startswith("x", F.lit("### ")), F.trim(F.substring("x", 5, 1 << 20))), ignorenulls=True).over(W.partitionBy("id", "tab").orderBy("line"))
    steps = lines.filter("kind = 'full'").withColumn("x", F.trim("x")).withColumn("s", section).filter(F.col("s").isin("Next steps", "Suggested next steps") & box).groupBy("id").agg(F.count(F.lit(1)).alias("steps"))
    out = got.select(
        "id", "date", F.trim(F.regexp_replace("title", r"\s*-\s*Transcript\s*$", "")).alias("title"), keep(F.transform("invited", lambda x: F.trim(x["label"]))).alias("participants"), keep(F.transform("invited", lambda x: F.lower(F.trim(x["url"])))).alias("emails"),
        F.transform(F.filter("files", lambda f: ~is_transcript(f)), lambda f: F.trim(f["url"])).alias("attachments"), F.element_at(F.transform(F.concat(F.filter("files", is_transcript), F.array(F.struct(F.lit("").alias("label"), F.lit("").alias("url")))), lambda f: F.trim(f["url"])), 1).alias("transcript_url"),
    )
    return out.join(steps, "id", "left").withColumn("steps", F.coalesce("steps", F.lit(0).cast("long")))
