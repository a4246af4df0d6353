"""Ordered rows: speaker islands, richest duplicates, later inputs, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def speaker_islands(segments: DataFrame) -> DataFrame:
    """segments (id, pos, speaker, text) -> (id, island, speaker, start, text): consecutive
    segments of one speaker as one, with the first one's place."""
    order = W.partitionBy("id").orderBy("pos")
    change = F.when(F.col("speaker").eqNullSafe(F.lag("speaker").over(order)) & F.lag("pos").over(order).isNotNull(), 0).otherwise(1)
    marked = segments.withColumn("change", change).withColumn("island", F.sum("change").over(order))
    grouped = marked.groupBy("id", "island").agg(F.first("speaker").alias("speaker"), F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    return grouped.select("id", "island", "speaker", "start", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def keep_richest(records: DataFrame, key: str, size: str, ordinal: str, carry: str | None = None) -> DataFrame:
    """The record of each key with the largest size; the earlier wins ties. carry: a column
    for which the first filled value of any duplicate stands in."""
    w = W.partitionBy(key).orderBy(F.desc(size), F.asc(ordinal))
    out = records.withColumn("__k", F.row_number().over(w))
    if carry:
        out = out.withColumn(carry, F.first(F.nullif(F.col(carry), F.lit("")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return out.filter("__k = 1").drop("__k")


def later_wins(records: DataFrame, key: str, ordinal: str, never_lose: str) -> DataFrame:
    """The last record of each key, with the last filled value of never_lose."""
    rest = [c for c in records.columns if c not in (key, never_lose)]
    filled = F.max(F.when(F.col(never_lose).isNotNull() & (F.col(never_lose) != ""), F.struct(ordinal, never_lose)))
    last = F.max(F.struct(ordinal, *[c for c in rest if c != ordinal]))
    got = records.groupBy(key).agg(last.alias("__l"), filled.alias("__f"))
    return got.select(key, *[F.col(f"__l.{c}").alias(c) for c in rest], F.col(f"__f.{never_lose}").alias(never_lose))


def ordered_distinct(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): distinct values in order of first appearance."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("__o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda x: x[value]).alias("values"))


def sessions(events: DataFrame, files: int = 30) -> DataFrame:
    """events (session, line, ts, role, text, file) -> one row a session: started and ended (the
    first and the last time by line), whole minutes between them, turns, the first prompt that
    isn't empty (of the role user, or last-prompt), last answer, files touched (distinct, sorted,
    capped). Sessions of neither turns nor a prompt are left out."""
    bot, turn = F.col("role") == "assistant", F.col("role").isin("user", "assistant")
    prompt = F.col("role").isin("user", "last-prompt") & (F.coalesce("text", F.lit("")) != "")
    got = events.groupBy("session").agg(
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line"))).alias("started"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("line"))).alias("ended"), F.count_if(turn).alias("turns"),
        F.min_by("text", F.when(prompt, F.col("line"))).alias("first_prompt"), F.max_by("text", F.when(bot, F.col("line"))).alias("last_answer"),
        F.slice(F.array_sort(F.collect_set("file")), 1, files).alias("files"),
    )
    got = got.filter("turns > 0 or first_prompt is not null")
    minutes = F.coalesce(((F.unix_millis("ended") - F.unix_millis("started")) / 60000).cast("long"), F.lit(0).cast("long"))
    return got.withColumn("minutes", minutes).withColumn("first_prompt", T.truncate(T.redact(F.col("first_prompt"))["text"])).withColumn("last_answer", T.truncate(T.redact(F.col("last_answer"))["text"]))
