"""Line deduplication by overlapping windows of three lines.

A window is three consecutive lines that aren't blank. All windows are hashed (two
64-bit hashes) and counted over all documents; the first place of each, by key and
line, stays, and every later place of a repeated window is removed. Removed windows
overlap, so a document loses the union of the lines they cover. Windows are judged on
the input, not on what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """docs with text replaced, and n_lines, n_removed.

    Lines end at line feeds and are compared as they are; blank ones (white space only)
    don't count and stay, unless no other line is left, when the text becomes empty. A
    null text stays null, with 0 lines; a document of fewer than width lines that count
    is left alone. Rows with a null key are left as they are and no place in them counts.
    Rows with one key and one text are one document and fare alike; rows with one key and
    different texts are documents of their own, in the order of their texts' hashes. An
    empty table gives no rows. Columns named n_lines or n_removed are replaced; all others
    pass through, whatever their names.

    A window that very many documents share is one key of the join with the first places,
    which has one row of it: Spark's skew handling divides it.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = "filter(transform(split(doc_text, '\n', -1), (x, i) -> struct(i, x)), p -> p.x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    whole, name = F.col(f"`{text}`").cast("string"), F.col(f"`{key}`")
    plain = docs.select(name.alias("key"), F.xxhash64(whole).alias("version"), whole.alias("doc_text"))
    grams = ", ".join(f"l[i + {j}].x" for j in range(width))
    windows = (
        plain.filter("key is not null").select("key", "version", F.expr(lines).alias("l")).filter(F.size("l") >= width)
        .selectExpr("key", "version", f"inline(transform(sequence(0, size(l) - {width}), i -> struct(i as pos, xxhash64({grams}) as a, xxhash64('second', {grams}) as b)))")
    )
    windows = common.materialise(windows, "windows")
    # repeated rows bring a place several times: what counts is whether a later place exists
    place = F.struct("key", "version", "pos")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("a", "b", "first")
    later = windows.join(first, ["a", "b"]).filter("struct(key, version, pos) > first").select("key", "version", "pos")
    covered = later.groupBy("key", "version").agg(F.expr(f"array_distinct(flatten(transform(collect_set(pos), p -> sequence(p, p + {width - 1}))))").alias("gone"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    whole_rows = docs.select(F.struct(F.lit(0), *others).alias("doc"), name.alias("key"), F.xxhash64(whole).alias("version"), whole.alias("doc_text"))
    joined = whole_rows.join(covered, ["key", "version"], "left").select("doc", "doc_text", "gone", F.expr(f"transform({lines}, p -> p.i)").alias("at"), F.split("doc_text", "\n", -1).alias("lines"))
    # positions among the lines that count -> positions among all; array_except keeps order
    kept = "array_except(sequence(0, size(lines) - 1), transform(gone, g -> at[g]))"
    n_lines, n_removed = F.coalesce(F.size("at"), F.lit(0)).cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    left = F.expr(f"case when gone is null then doc_text when size(gone) = size(at) then '' else array_join(transform({kept}, i -> lines[i]), '\n') end")
    return joined.select(*[left.alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = {
    "op7_line_dedup": r"""
        WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents),
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
        w AS (SELECT doc_id, p, i AS i1, lead(i, 1) OVER d AS i2, lead(i, 2) OVER d AS i3, [x, lead(x, 1) OVER d, lead(x, 2) OVER d] AS g FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w WHERE i3 IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM r WHERE k > 1),
        n AS (SELECT doc_id, count(*) AS n_lines FROM c GROUP BY 1),
        m AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1),
        t AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               sha256(CASE WHEN n_removed IS NULL THEN coalesce(text, '') WHEN n_removed = n_lines THEN '' ELSE t END) AS kept_sha256
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
QUERIES = {"op7_line_dedup": op7_line_dedup}
