"""Pages and reports as text columns, and what is kept of the page that was there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def between(old: Column, start: str, end: str) -> Column:
    """What stands between two marks; null where they aren't there."""
    import re

    pattern = rf"(?s){re.escape(start)}\s*\n(.*?)\n\s*{re.escape(end)}"
    return F.when(old.rlike(pattern), F.regexp_extract(old, pattern, 1))


def keep_region(new: DataFrame, old: DataFrame, key: str, start: str, end: str, default: str = "") -> DataFrame:
    """new (key, head, tail) -> (key, text): head, the old page's editable region, tail."""
    kept = old.select(key, between(F.col("text"), start, end).alias("__kept"))
    region = F.concat(F.lit(f"{start}\n"), F.coalesce("__kept", F.lit(default)), F.lit(f"\n{end}"))
    return new.join(kept, key, "left").select(key, F.concat_ws("\n\n", "head", region, "tail").alias("text"))


def frontmatter(**fields: Column) -> Column:
    """A block of scalars; null ones are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), T.yaml_str(v.cast("string")))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def table_row(*cells: Column) -> Column:
    """A row of a markdown table; bars in cells are escaped."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def patterns_report(ranked: DataFrame, order: list) -> DataFrame:
    """ranked patterns (slug, items, source_list, first, latest, and variants, if there are some), a few
    hundred at most -> one row, the report; payloads.report_rows reads it again."""
    from pyspark.sql.window import Window as W

    numbered = ranked.withColumn("n", F.row_number().over(W.orderBy(*order)))
    words = F.col("variants") if "variants" in ranked.columns else F.array(T.title_case(F.col("slug")))
    row = table_row(F.col("n"), F.array_join(F.slice(words, 1, 3), "; "), F.col("first"), F.col("latest"), F.col("items"), F.array_join("source_list", ", "), F.concat(F.lit("`"), "slug", F.lit("`")))
    rows = numbered.select("n", row.alias("row")).agg(F.array_sort(F.collect_list(F.struct("n", "row"))).alias("rows"))
    head = "| # | Keywords | First | Latest | Items | Sources | Slug |\n|---|---|---|---|---|---|---|\n"
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n")).alias("report"))


def book_note(title: Column, author: Column, summary: Column, ideas: Column, quotes: Column) -> Column:
    """A book's note of its fields; empty sections are left out."""
    part = lambda name, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(f"## {name}\n\n- "), F.array_join(c, "\n- ")))
    head = F.concat(F.lit("# "), title, F.lit("\n\n*"), author, F.lit("*"))
    return F.concat(F.concat_ws("\n\n", head, F.concat(F.lit("## Summary\n\n"), F.nullif(summary, F.lit(""))), part("Key ideas", ideas), part("Quotes", quotes)), F.lit("\n"))


def append_log(log: DataFrame, **entry: Column) -> DataFrame:
    """log with one more row."""
    return log.unionByName(log.sparkSession.range(1).select(*[v.cast(log.schema[k].dataType).alias(k) for k, v in entry.items()]))
