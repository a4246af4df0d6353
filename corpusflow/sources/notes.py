"""Scans of a folder of notes: one row a file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import frontmatter as fm

#: Folders that are never read.
EXCLUDED = (".obsidian", ".git", ".trash", ".smart-env", "node_modules")


def scan(spark: SparkSession, root: str, excluded: Iterable[str] = EXCLUDED, readme: bool = False, attachments: str | None = None, root_files: Iterable[str] = ()) -> DataFrame:
    """(rel, folder, stem, mtime, text, fm, title, body) of all .md files below root.

    Unreadable files are skipped, dotfiles too, README.md unless asked for, the attachments
    folder, and root_files (such as AGENTS.md) at the root itself."""
    excluded = (*excluded, attachments) if attachments else tuple(excluded)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).text(root, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rel = F.ltrim(F.regexp_replace(path, r"^[a-z]+:/*", "/"), F.lit("/"))
    top = root.split(":", 1)[-1].strip("/") + "/"
    rows = files.select(F.regexp_replace(rel, "^" + _quoted(top), "").alias("rel"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("text"))
    parts = F.split("rel", "/")
    keep = ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in excluded])) & ~F.exists(parts, lambda x: F.startswith(x, F.lit(".")))
    if not readme:
        keep &= F.element_at(parts, -1) != "README.md"
    if root_files:
        keep &= ~F.col("rel").isin(*root_files)
    return with_frontmatter(rows.filter(keep).withColumn("folder", F.regexp_replace("rel", "/[^/]*$", "")).withColumn("stem", F.regexp_extract("rel", r"([^/]*)\.md$", 1)))


def _quoted(s: str) -> str:
    import re

    return re.escape(s)


def with_frontmatter(notes: DataFrame) -> DataFrame:
    """notes (with text and stem) with fm, body and title."""
    return notes.withColumn("fm", fm.parse(F.col("text"))).withColumn("body", fm.body(F.col("text"))).withColumn("title", T.title(F.col("body"), F.col("stem")))


def source_of(rel: Column, raw: str = "raw") -> Column:
    """raw/<source>/... -> source, with raw/wispr/meetings as one of its own; else the first part."""
    parts = F.split(rel, "/")
    return F.when(F.startswith(rel, F.lit(f"{raw}/wispr/meetings/")), F.lit("wispr-meetings")).when((parts[0] == raw) & (F.size(parts) > 2), parts[1]).otherwise(parts[0])


#: Where a note's date is looked for: by emergence, by evidence, by lint.
EMERGE_KEYS = ("date", "timestamp", "started", "created_at", "ingested_at")
EVIDENCE_KEYS = ("date", "timestamp", "started", "created_at")
LINT_KEYS = ("date", "timestamp", "last_evidence", "generated_at", "ingested_at")


def evidence_date(fm_: Column, mtime: Column, keys: Iterable[str] = EVIDENCE_KEYS) -> Column:
    """The first ten characters of the first filled key, a date or not; else the file's date. As text."""
    return F.coalesce(*[F.nullif(F.substring(F.trim(fm.scalar(fm_, k)), 1, 10), F.lit("")) for k in keys], F.to_date(mtime).cast("string"))


def note_date(fm_: Column, mtime: Column, keys: Iterable[str] = EMERGE_KEYS) -> Column:
    """The first key that starts with a date, else the file's date."""
    return F.coalesce(*[F.try_to_timestamp(F.substring(fm.scalar(fm_, k), 1, 10), F.lit("yyyy-MM-dd")).cast("date") for k in keys], F.to_date(mtime))


def in_folders(notes: DataFrame, folders: Iterable[str]) -> DataFrame:
    """Notes below any of the folders."""
    keep = F.lit(False)
    for f in folders:
        keep |= F.startswith(F.col("rel"), F.lit(f.rstrip("/") + "/"))
    return notes.filter(keep)


def links(notes: DataFrame) -> DataFrame:
    """(stem, target): wikilinks, distinct, without section and alias."""
    return notes.select("stem", F.explode(F.array_distinct(F.transform(T.extract(F.col("text"), r"\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]+)?\]\]"), lambda x: F.trim(x)))).alias("target"))
