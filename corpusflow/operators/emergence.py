"""Pattern emergence: slugs that keep turning up across items and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import written


def mentions(items: DataFrame, deny: DataFrame | None = None, body_chars: int | None = 1000, least: int = 5) -> DataFrame:
    """items (unit, unit_source, date, title, body) -> (unit, unit_source, date, slug).

    Slugs of fewer than ``least`` characters, of digits only, of noise, and those whose
    fuzzy key is in deny (fuzzy_key) are left out. body_chars: None for whole bodies."""
    body = F.coalesce("body", F.lit(""))
    body = F.substring(body, 1, body_chars) if body_chars else body
    slugs = items.select("unit", "unit_source", "date", F.explode(T.candidates(F.concat("title", F.lit("\n"), body))).alias("slug"))
    slugs = slugs.filter((F.length("slug") >= least) & ~F.col("slug").rlike("^[0-9]+$") & ~F.col("slug").isin(*T.NOISE))
    if deny is not None:  # small by nature: names of entities, concepts, people, threads
        slugs = slugs.join(deny.select("fuzzy_key").distinct(), T.fuzzy_key(F.col("slug")) == F.col("fuzzy_key"), "left_anti")
    return slugs


def deny_set(**names: DataFrame) -> DataFrame:
    """(fuzzy_key) of all given one-column frames of names."""
    out = None
    for df in names.values():
        keys = df.select(T.fuzzy_key(F.col(df.columns[0])).alias("fuzzy_key")).filter("fuzzy_key <> ''")
        out = keys if out is None else out.union(keys)
    return out.distinct()


def score(items: Column, sources: Column) -> Column:
    return items * (1.0 + (sources - 1) * 0.5)


def emerge(items: DataFrame, today: str | None = None, window_days: int = 30, top: int | None = 25, min_items: int = 3, min_sources: int = 2, deny: DataFrame | None = None, body_chars: int | None = 1000) -> DataFrame:
    """(slug, items, sources, source_list, first, latest, score), best first.

    With today, only items of the last window_days count; future ones do."""
    if today is not None:
        items = items.filter(F.col("date") >= F.date_sub(F.lit(today).cast("date"), window_days))
    found = (
        mentions(items, deny, body_chars).groupBy("slug")
        .agg(F.countDistinct("unit").alias("items"), F.array_sort(F.collect_set("unit_source")).alias("source_list"), F.min("date").alias("first"), F.max("date").alias("latest"))
        .withColumn("sources", F.size("source_list").cast("long"))
        .filter((F.col("items") >= min_items) & (F.col("sources") >= min_sources))
        .withColumn("score", score(F.col("items"), F.col("sources")))
    )
    ranked = found.orderBy(F.desc("score"), F.desc("items"), "slug")
    return ranked.limit(top) if top else ranked


#: Tokens of more than one edge in FREQUENT, FREQUENT of them at most, are joined by a broadcast.
FREQUENT = 512


def group_records(records: DataFrame, order: list[str]) -> DataFrame:
    """records (rec, source, tokens: array of "source:id") -> (rec, unit, unit_source).

    Records that share a token, directly or through others, are one unit; its source is
    that of the member whose source comes first in order, then the least rec. Least
    labels travel over record-token edges with pointer jumping, by partial minima; a token that a
    large share of all records has is broadcast and not one task's. Every round is written to
    the shared folder."""
    edges = written(records.select("rec", F.explode("tokens").alias("token")).distinct(), "edges")
    total = edges.count()
    common = edges.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * FREQUENT >= total).select("token")
    hot = F.broadcast(common)  # FREQUENT rows
    labels = written(records.select("rec", F.col("rec").alias("label")).distinct(), "labels")
    while True:
        named = edges.join(labels, "rec")
        token = named.groupBy("token").agg(F.min("label").alias("t"))
        often = edges.join(F.broadcast(token.join(hot, "token", "left_semi")), "token")
        rest = edges.join(hot, "token", "left_anti").join(token.join(hot, "token", "left_anti"), "token")
        near = often.select("rec", "t").unionByName(rest.select("rec", "t")).groupBy("rec").agg(F.min("t").alias("n"))
        step = labels.join(near, "rec", "left").select("rec", F.col("label").alias("was"), F.least("label", F.coalesce("n", "label")).alias("label"))
        jump = step.select(F.col("rec").alias("label"), F.col("label").alias("further"))
        new = written(step.join(jump, "label", "left").select("rec", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = new.select("rec", "label")
        if new.filter("was <> label").isEmpty():
            break
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("source")), F.lit(0)), F.lit(len(order) + 1))
    lead = records.join(labels, "rec").groupBy("label").agg(F.min(F.struct(rank.alias("r"), "rec", "source")).alias("lead"))
    return labels.join(lead, "label").select("rec", F.col("lead.rec").alias("unit"), F.col("lead.source").alias("unit_source"))
