"""Hygiene: links, frontmatter, inbox, tasks, and the table builder of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import frontmatter as fm


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """notes without a link from another note: left anti on the name."""
    return notes.join(links.filter("stem <> target").select(F.col("target").alias("stem")).distinct(), "stem", "left_anti")


def broken_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, files, examples): targets that no note has, in their own case."""
    lost = links.join(notes.select(F.col("stem").alias("target")).distinct(), "target", "left_anti")
    return lost.groupBy("target").agg(F.countDistinct("stem").alias("files"), F.min("stem").alias("example"))


def stale(raw: DataFrame, links: DataFrame, wiki: DataFrame, today: str, days: int = 30, top: int | None = 50) -> DataFrame:
    """raw (stem, note_date) of days or more that neither a wiki page (wiki: stem, mentioned)
    nor a note outside raw links; oldest first."""
    old = raw.withColumn("age", F.datediff(F.lit(today).cast("date"), "note_date")).filter(F.col("age") >= days)
    old = old.join(wiki.select(F.col("mentioned").alias("stem")).distinct(), "stem", "left_anti")
    old = old.join(links.select(F.col("target").alias("stem")).distinct(), "stem", "left_anti").orderBy(F.desc("age"), "stem")
    return old.limit(top) if top else old


def violations(notes: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """notes (rel, fm) -> (rel, type, missing): keys that the note's type requires."""
    rules = F.create_map(*[x for k, v in required.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    kind = F.coalesce(fm.scalar(F.col("fm"), "type"), F.lit(""))
    want = F.coalesce(F.try_element_at(rules, kind), F.array(F.lit("type")))
    have = F.map_keys(F.map_filter("fm", lambda _, v: F.size(v) > 0))
    return notes.select("rel", kind.alias("type"), F.array_sort(F.array_except(want, have)).alias("missing")).filter(F.size("missing") > 0)


def overflow(notes: DataFrame, most: int = 20) -> DataFrame:
    """(folder, n) of folders with more notes than that."""
    return notes.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def tasks(notes: DataFrame) -> DataFrame:
    """notes (rel, text) -> (rel, line, done, due, completed, text): one row a task line."""
    lines = notes.select("rel", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    found = lines.filter(F.col("x").rlike(r"^\s*- \[[ xX]\] "))
    day = lambda mark, word: F.try_to_timestamp(F.regexp_extract("x", rf"(?:{mark}\s*|{word}:\s*)(\d{{4}}-\d{{2}}-\d{{2}})", 1), F.lit("yyyy-MM-dd")).cast("date")
    return found.select("rel", "line", F.col("x").rlike(r"^\s*- \[[xX]\]").alias("done"), day("📅", "due").alias("due"), day("✅", "completion").alias("completed"), F.trim(F.regexp_replace("x", r"^\s*- \[[ xX]\] ", "")).alias("text"))


def overdue(found: DataFrame, today: str) -> DataFrame:
    return found.filter(~F.col("done") & (F.col("due") < F.lit(today).cast("date")))


def completed_in_week(found: DataFrame, day: str) -> DataFrame:
    """Tasks completed from Monday to Sunday of the day's week."""
    monday = F.to_date(F.date_trunc("week", F.lit(day).cast("date")))
    return found.filter(F.col("done") & F.col("completed").between(monday, F.date_add(monday, 6)))


def open_tasks(found: DataFrame, *folders: str, top: int = 25) -> DataFrame:
    """Open tasks of folders, the most pressing first: by due date, those without one last."""
    keep = F.lit(not folders)
    for f in folders:
        keep |= F.startswith("rel", F.lit(f.rstrip("/") + "/"))
    return found.filter(~F.col("done") & keep).orderBy(F.asc_nulls_last("due"), "rel", "line").limit(top)


def in_week(notes: DataFrame, day: str, column: str = "note_date") -> DataFrame:
    """Notes of the day's week, Monday to Sunday."""
    monday = F.to_date(F.date_trunc("week", F.lit(day).cast("date")))
    return notes.filter(F.col(column).between(monday, F.date_add(monday, 6))).orderBy(column, "rel")


def week_numbers(notes: DataFrame, found: DataFrame, activity: DataFrame, day: str, meeting: Column) -> DataFrame:
    """(what, n) of the day's week: notes (rel, note_date), meetings among them, tasks (of ``tasks``) that
    were completed, threads (of threads.activity) by state. What has none counts 0."""
    week = in_week(notes, day)
    parts = [week.agg(F.lit("notes").alias("what"), F.count(F.lit(1)).alias("n")), week.agg(F.lit("meetings").alias("what"), F.count_if(meeting).alias("n")), completed_in_week(found, day).agg(F.lit("tasks completed").alias("what"), F.count(F.lit(1)).alias("n"))]
    parts += [activity.agg(F.lit(f"threads {s}").alias("what"), F.count_if(F.col("state") == s).alias("n")) for s in ("active", "stalled")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Table:
    """TABLE ... FROM ... WHERE ... SORT ... LIMIT over a view of notes."""

    def __init__(self, notes: DataFrame):
        self.df = notes

    def from_(self, *folders: str) -> Table:
        keep = F.lit(False)
        for f in folders:
            keep |= F.startswith("rel", F.lit(f))
        return Table(self.df.filter(keep))

    def where(self, condition: Column | str) -> Table:
        return Table(self.df.filter(condition))

    def sort(self, *keys: Column | str) -> Table:
        return Table(self.df.orderBy(*keys))

    def limit(self, n: int) -> Table:
        return Table(self.df.limit(n))

    def table(self, *columns: Column | str) -> DataFrame:
        return self.df.select(*columns)
