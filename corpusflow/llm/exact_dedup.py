"""Exact deduplication with a heavy-hitter split.

1. Every text is normalised (A-Z lowered) and digested once, by SQL functions; the
   digests (no texts) are kept as a table in the shared folder.
2. Misra-Gries summaries of ``counters`` entries, one a partition, find digests that
   may hold a ``1 / frequent`` share of the rows. A digest with f of n rows has
   summed counters of at least f - n / (counters + 1), so every true heavy hitter
   passes the bound, and the summed counters being at most n, no more than
   frequent * counters / (counters - frequent) digests do: a proven size.
3. Those candidates are counted exactly (partial aggregation) and their winners
   broadcast: rows of heavy groups never leave their map task.
4. Digests that are left have fewer than n / frequent rows each and go through one
   ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common



def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, digest): SHA-256 of each normalised text in UTF-8; null counts as empty."""

    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return docs.select(F.col(key).cast("long").alias("key"), F.unhex(F.sha2(low, 256)).alias("digest"))


def heavy(table: DataFrame, n: int, frequent: int, counters: int) -> DataFrame:
    """Digests that may hold at least n / frequent rows, by Misra-Gries summaries."""

    def run(batches):
        summary: Counter = Counter()
        for batch in batches:
            summary.update(batch.column(0).to_pylist())
            if len(summary) > counters:  # as many decrements as Misra-Gries' own, all at once
                cut = sorted(summary.values(), reverse=True)[counters]
                summary = Counter({k: v - cut for k, v in summary.items() if v > cut})
        yield pa.RecordBatch.from_arrays([pa.array(list(summary), pa.binary()), pa.array(list(summary.values()), pa.int64())], ["digest", "n"])

    summed = table.select("digest").mapInArrow(run, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return summed.filter(F.col("n") >= n / frequent - n / (counters + 1)).select("digest")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", frequent: int = 512, counters: int = 4096) -> DataFrame:
    """One row a document: key, keep_id (largest key of equal texts), group_size, kept,
    text_sha256.

    Null and empty texts are equal to each other. Rows that repeat a key count one by
    one; only the row or rows with the largest key are kept. Texts of any length are
    digested whole, and only digests travel. An empty table gives no
    rows. Other columns of docs are not looked at.
    """
    seen = common.materialise(digests(docs, text, key), "digests")
    n = seen.count()
    candidates = heavy(seen, n, frequent, counters)
    winners = common.materialise(
        seen.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.max("key").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") >= n / frequent),
        "winners",
    )
    split = seen.join(F.broadcast(winners), "digest", "left")
    hot = split.filter(F.col("group_size").isNotNull())
    group = W.partitionBy("digest")
    cold = split.filter(F.col("group_size").isNull()).select("key", "digest", F.max("key").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"))
    return hot.select("key", "digest", "keep_id", "group_size").unionByName(cold).select(
        F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)"""
}
QUERIES = {"op3_exact_dedup": op3_exact_dedup}
