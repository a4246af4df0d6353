"""Merge policies: what an incoming batch does to what is there, as a plan.

A plan is the incoming rows with an ``action``; ``apply`` makes the new table of it.
Nothing is written by a plan, so a dry run is the plan itself, and applying a batch twice
gives ``unchanged`` for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_only(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """insert where the key is new, else unchanged."""
    known = existing.select(key).distinct().withColumn("__k", F.lit(True))
    return incoming.dropDuplicates([key]).join(known, key, "left").withColumn("action", F.when(F.col("__k"), "unchanged").otherwise("insert")).drop("__k")


def by_value(incoming: DataFrame, existing: DataFrame, key: str, stamp: str) -> DataFrame:
    """insert, update where the stamp (a hash, a time, a composite) differs, or unchanged."""
    old = existing.select(key, F.col(stamp).alias("__old"), F.lit(True).alias("__k"))
    action = F.when(F.col("__k").isNull(), "insert").when(F.col("__old").eqNullSafe(F.col(stamp)), "unchanged").otherwise("update")
    return incoming.join(old, key, "left").withColumn("action", action).drop("__old", "__k")


def content_hash(*columns: Column) -> Column:
    """A stable hash of several columns, null and empty told apart."""
    return F.sha1(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}))


def record_states(incoming: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """incoming (id, valid, has_content, hash), existing (id, kind, hash), kind one of stub,
    summary, other -> status: error, conflict, no-content, stub-written, fresh, enriched,
    already-current."""
    old = existing.select(key, F.col("kind").alias("__kind"), F.col("hash").alias("__hash"))
    k = F.col("__kind")
    status = (
        F.when(F.col(key).isNull() | ~F.col("valid"), "error").when(k == "other", "conflict")
        .when(~F.col("has_content"), F.when(k.isNull(), "stub-written").otherwise("no-content"))
        .when(k.isNull(), "fresh").when(F.col("__hash").eqNullSafe(F.col("hash")) & (k == "summary"), "already-current").otherwise("enriched")
    )
    return incoming.join(old, key, "left").withColumn("status", status).drop("__kind", "__hash")


def apply(plan: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The table after a plan: inserted and updated rows new, all others as they were."""
    new = plan.filter(F.col("action").isin("insert", "update")).select(existing.columns)
    return existing.join(new.select(key), key, "left_anti").select(existing.columns).unionByName(new)


def counters(plan: DataFrame, column: str = "action") -> DataFrame:
    """(action, n) of a plan, in one aggregate."""
    return plan.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# --- cursors -------------------------------------------------------------------------


def high_water(observed: DataFrame, column: str, overlap_hours: int = 24, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, cursor): the newest time that was seen, less the overlap; null without rows, so a
    run that finds nothing leaves a cursor alone."""
    return observed.groupBy(*by).agg((F.max(column) - F.expr(f"INTERVAL {overlap_hours} HOURS")).alias("cursor"))


def since(rows: DataFrame, column: str, cursor: str | None, lookback_days: int, today: str, first_days: int = 30) -> DataFrame:
    """rows from the cursor less the lookback on; in a first run, of the last first_days."""
    start = F.date_sub(F.lit(cursor[:10]).cast("date"), lookback_days) if cursor else F.date_sub(F.lit(today).cast("date"), first_days)
    return rows.filter(F.col(column) >= start)


def heal_window(today: str, days: int, last_run: str | None) -> str:
    """The window's start, moved back to the day before the last run if that is earlier."""
    import datetime as dt

    start = dt.date.fromisoformat(today) - dt.timedelta(days=days)
    return min(start, dt.date.fromisoformat(last_run[:10]) - dt.timedelta(days=1)).isoformat() if last_run else start.isoformat()


def next_cursor(newest: str | None, old: str | None) -> str | None:
    """One second past the newest time; without one the old cursor stays. A date alone is
    refused: as text it would sort before every time of its day."""
    import datetime as dt

    if newest is None:
        return old
    if len(newest.strip()) <= 10:
        raise ValueError("a cursor needs a time of day")
    return (dt.datetime.fromisoformat(newest.replace("Z", "+00:00")) + dt.timedelta(seconds=1)).isoformat()
