"""Substring deduplication: windows of 50 words that repeat across documents.

A word is removed if a window that covers it starts, word for word, in a document with
a smaller key. Windows are judged on the input.

1. Count-min prefilter. A window's cells depend on its anchor, the least hash of the
   32-word sequences in it: equal windows have equal anchors, and neighbouring windows
   mostly share one, so a partition's sketch has a cell for about every tenth window.
   Sketches are summed chunk by chunk (a shuffle of sparse cells). A sum is never less
   than the number of documents with the anchor, so no repeated window is lost.
2. A second pass keeps only windows whose cells all hold two or more, as segments: runs
   of neighbouring windows with one anchor. Their first and last window hash name the
   whole segment; single windows are not written.
3. Exact grouping, segments first: one that also starts in a document with a smaller
   key loses all its windows. For any window, the document with the least key has it in
   a segment that isn't resolved that way, so what is left need only be held against
   what is left: windows of unresolved segments, and only those whose anchor still is
   in two documents, are grouped one by one. The anchors of these segments make a second
   sketch, and a last pass over the texts hashes only the windows it lets through.

The sketch has ``2**bits`` cells in two rows, by Catalyst's estimate of the input; it
stays in the shared folder, is read by each worker and never comes to the driver. Names
that hold a large share of all segments (a very common passage) are broadcast, 512 at
most; the others shuffle. Windows are told apart by 96 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words

U = np.uint64
ROWS, CHUNK_BITS, MOST_BITS, SEGMENT, FREQUENT = 2, 20, 29, 48, 512
_BASE, _BASE2 = U(0x9E6C63D0876A9A35), U(0xD1342543DE82EF95)


def _inverse(x: U) -> U:
    return U(pow(int(x), -1, 1 << 64))


class _Rolling:
    """Hashes of n consecutive words by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, base: U):
        self.base, self.inverse = base, _inverse(base)
        self.power = self.back = np.ones(1, U)

    def __call__(self, hashes: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
        n = len(hashes)
        if len(self.power) < n:
            self.power = np.cumprod(np.concatenate([[U(1)], np.full(n, self.base)]))
            self.back = np.cumprod(np.concatenate([[U(1)], np.full(n, self.inverse)]))
        sums = np.zeros(n + 1, U)
        np.cumsum(words.mix(hashes ^ self.base) * self.power[:n], out=sums[1:])
        return [words.mix((sums[k:] - sums[:-k]) * self.back[: n - k + 1]) if n >= k else np.zeros(0, U) for k in lengths]


_ROLL, _ROLL2 = _Rolling(_BASE), _Rolling(_BASE2)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def windows(w: words.Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: first word of each window, its document, its hash, its anchor."""
    n = np.diff(w.first)
    per = np.maximum(0, n - width + 1)
    doc = np.repeat(np.arange(len(n)), per)
    if not len(doc):
        return doc, doc, np.zeros(0, U), np.zeros(0, U)
    at = w.first[:-1][doc] + np.arange(len(doc)) - (np.cumsum(per) - per)[doc]
    whole, short = _ROLL(w.hashes, (width, anchor))
    return at, doc, whole[at], _least(short, width - anchor + 1)[at]


def _starts(doc: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Whether a window's anchor isn't that of the window before it."""
    new = np.ones(len(doc), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
    return new


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return words.mix(anchors + words.times(row + 1, _BASE2)) >> U(64 - bits)


def _sparse(held: list[np.ndarray], bits: int):
    """Cells of these anchors, a batch for each row of the sketch: a binary of cells for
    each chunk, the top bit of a cell set if it was hit twice."""
    anchors = np.concatenate(held)
    for row in range(ROWS):
        cells, counts = np.unique(_cells(anchors, row, bits), return_counts=True)
        chunks = cells >> U(min(CHUNK_BITS, bits))
        cuts = np.flatnonzero(np.diff(chunks, prepend=chunks[:1] + U(1)))
        low = (cells & U((1 << CHUNK_BITS) - 1)).astype("<u4") | (np.minimum(counts, 2) == 2).astype("<u4") << np.uint32(31)
        yield pa.RecordBatch.from_arrays([pa.array([row] * len(cuts), pa.int32()), pa.array(chunks[cuts].astype(np.int64)), pa.array([x.tobytes() for x in np.split(low, cuts[1:])] if len(cuts) else [], pa.binary())], ["row", "chunk", "cells"])


def _merged(sparse: DataFrame, bits: int, least: int, name: str) -> str:
    """The path of the merged sketch: chunks of cells, a bit for each that holds least or more."""

    def merge(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, chunk, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault((row, chunk), np.zeros(1 << min(CHUNK_BITS, bits), np.uint8))
                x = np.frombuffer(cells, "<u4")
                at = x & np.uint32((1 << 31) - 1)
                total[at] = np.minimum(2, total[at] + 1 + (x >> np.uint32(31)))
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([np.packbits(sums[k] >= least).tobytes() for k in keys], pa.binary())], ["row", "chunk", "bits"])

    spark = sparse.sparkSession
    chunks = ROWS << max(0, bits - CHUNK_BITS)
    path = common.scratch(spark, name)
    tasks = max(1, chunks // 16, min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sparse.repartition(tasks, "row", "chunk").mapInArrow(merge, "row int, chunk long, bits binary").write.parquet(path)
    return common.arrow_uri(spark, path)


def sketch(texts: DataFrame, width: int, anchor: int, bits: int) -> str:
    """The merged sketch of all texts' anchors: a bit for each cell hit twice or more."""

    def partial(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for w in words.each(batch.column(2), lower=False):
                _, doc, _, anchors = windows(w, width, anchor)
                held.append(anchors[_starts(doc, anchors)])
                if sum(map(len, held)) > 1 << 21:
                    yield from _sparse(held, bits)
                    held.clear()
        if held:
            yield from _sparse(held, bits)

    return _merged(texts.mapInArrow(partial, "row int, chunk long, cells binary"), bits, 2, "sketch")


def _mark(anchors: DataFrame, bits: int) -> str:
    """A sketch with the cells of these anchors, a long each, set."""

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _sparse([batch.column(0).to_numpy(zero_copy_only=False).view(U)], bits)

    return _merged(anchors.mapInArrow(partial, "row int, chunk long, cells binary"), bits, 1, "marked")


_SKETCHES: dict[str, np.ndarray] = {}


def _load(path: str, bits: int) -> np.ndarray:
    """Rows of packed bits; a worker keeps the last one read."""
    if path not in _SKETCHES:
        _SKETCHES.clear()
        out = np.zeros((ROWS, 1 << max(0, bits - 3)), np.uint8)
        size = 1 << (min(CHUNK_BITS, bits) - 3)
        store, at = pafs.FileSystem.from_uri(path)
        for f in store.get_file_info(pafs.FileSelector(at)):
            if f.path.endswith(".parquet"):
                for r in pq.read_table(f.path, filesystem=store).to_pylist():
                    out[r["row"], r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        _SKETCHES[path] = out
    return _SKETCHES[path]


def segments(texts: DataFrame, width: int, anchor: int, bits: int, path: str, hashes: bool) -> DataFrame:
    """Runs of windows that the sketch takes for repeated: key, version, anchor, first word
    and number of windows; and with hashes those of the windows, else a name of two longs
    for the whole run."""
    heads, tails = ["key", "version", "anchor", "pos", "n"], ["w", "v"] if hashes else ["name", "name2"]

    def run(batches):
        repeated = _load(path, bits)
        for batch in batches:
            keys, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for w in words.each(batch.column(2), lower=False):
                at, doc, whole, anchors = windows(w, width, anchor)
                if not len(at):
                    continue
                ok = np.ones(len(at), bool)
                for row in range(ROWS):
                    c = _cells(anchors, row, bits)
                    ok &= (repeated[row][(c >> U(3)).astype(np.int64)] >> (7 - (c & U(7)).astype(np.uint8)) & 1).astype(bool)
                at, doc, whole, anchors = at[ok], doc[ok], whole[ok], anchors[ok]
                if not len(at):
                    continue
                second = _ROLL2(w.hashes, (width,))[0][at] >> U(32)
                new = _starts(doc, anchors)
                new[1:] |= at[1:] != at[:-1] + 1
                begin = np.flatnonzero(new)
                # no run longer than SEGMENT, so that its first and last window hold all its words
                place = np.arange(len(at)) - begin[np.cumsum(new) - 1]
                begin = np.flatnonzero(place % SEGMENT == 0)
                end = np.append(begin[1:], len(at))
                n, d = end - begin, doc[begin]
                if hashes:
                    cuts = pa.array(np.append(begin, len(at)), pa.int32())
                    more = [pa.ListArray.from_arrays(cuts, pa.array(whole.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(second.astype(np.uint32).view(np.int32)))]
                else:
                    name = words.mix(whole[begin] * _BASE + words.mix(whole[end - 1] + n.astype(U)))
                    name2 = words.mix(second[begin] + (second[end - 1] << U(32)) + n.astype(U) * _BASE2)
                    more = [pa.array(name.view(np.int64)), pa.array(name2.view(np.int64))]
                columns = [keys[w.lo + d], versions[w.lo + d], anchors[begin].view(np.int64), (at[begin] - w.first[d]).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *more], [*heads, *tails])

    return texts.mapInArrow(run, "key long, version long, anchor long, pos int, n int, " + ("w array<long>, v array<int>" if hashes else "name long, name2 long"))


def _least_keys(found: DataFrame, names: list[str]) -> DataFrame:
    """found with resolved: whether its names also occur with a smaller key. Names of more
    than one row in FREQUENT, FREQUENT of them at most, are broadcast; the others shuffle."""
    least = common.materialise(found.groupBy(*names).agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count(F.lit(1)).alias("rows")).filter("least < most").drop("most"), "least")
    most = least.agg(F.max("rows")).first()[0]
    total = found.count()
    if not most or most * FREQUENT < total:
        return found.join(least.drop("rows"), names, "left").withColumn("resolved", F.expr("coalesce(least < key, false)")).drop("least")
    heavy = F.broadcast(least.filter(F.col("rows") * FREQUENT >= total).select(*names, F.col("least").alias("hot")))
    split = found.join(heavy, names, "left")
    hot = split.filter("hot is not null").withColumn("resolved", F.expr("hot < key")).drop("hot")
    cold = split.filter("hot is null").drop("hot").join(least.drop("rows"), names, "left")
    return hot.unionByName(cold.withColumn("resolved", F.expr("coalesce(least < key, false)")).drop("least"))


def removals(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 50, anchor: int = 32, bits: int | None = None) -> DataFrame:
    """(key, version, runs): for each document that loses words, an array of (pos, n): the
    windows from word pos to pos + n - 1, each of width words, are removed. version: a hash
    of the text, which tells rows of one key and different texts apart."""
    if bits is None:  # about 8 cells for each anchor, at 10 words each
        bits = min(MOST_BITS, max(16, (common.input_bytes(docs) // 8).bit_length()))
    whole = F.col(f"`{text}`").cast("string")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.xxhash64(whole).alias("version"), whole.alias("text")).filter("key is not null and text is not null")
    found = common.materialise(segments(texts, width, anchor, bits, sketch(texts, width, anchor, bits), False), "segments")
    judged = common.materialise(_least_keys(found, ["name", "name2"]).drop("name", "name2"), "judged")
    common.discard(found)
    left = judged.filter("not resolved")
    shared = left.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("anchor")
    places = common.materialise(left.join(shared, "anchor", "left_semi").select("key", "version", "anchor", "pos", "n").distinct(), "places")
    # the windows of these places: their anchors make a sketch of their own, so that a pass over the
    # texts yields hashes for hardly more than them
    few = common.materialise(segments(texts, width, anchor, bits, _mark(places.select("anchor").distinct(), bits), True), "windows")
    single = few.join(places.select("key", "version", "pos"), ["key", "version", "pos"], "left_semi").selectExpr("key", "version", "pos", "posexplode(arrays_zip(w, v)) as (i, h)").selectExpr("key", "version", "pos + i as pos", "h.w as w", "h.v as v")
    later = _least_keys(common.materialise(single, "single"), ["w", "v"]).filter("resolved").selectExpr("key", "version", "pos", "1 as n")
    return judged.filter("resolved").select("key", "version", "pos", "n").unionByName(later).groupBy("key", "version").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))


def substring_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 50, anchor: int = 32, bits: int | None = None) -> DataFrame:
    """docs with text made of the words that are left, joined by one space, and n_words,
    n_removed.

    Null texts stay null, with 0 words; texts of fewer than width words, and repeats
    inside one document, are kept. Rows with equal keys are one document to this rule: none is
    removed for the other, whether their texts are equal or not. A row with a null key removes
    nothing and loses nothing. An empty table gives no rows. Columns named n_words or n_removed
    are replaced; all others pass through, whatever their names.
    """
    docs = docs.drop("n_words", "n_removed")
    at, by = docs.columns.index(text), docs.columns.index(key)
    gone = removals(docs, text, key, width, anchor, bits)
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumns({"key": F.col(f"c{by}").cast("long"), "version": F.xxhash64(F.col(f"c{at}").cast("string"))})
    joined = flat.join(gone, ["key", "version"], "left").drop("key", "version")

    def run(batches):
        for batch in batches:
            runs = batch.column(len(batch.columns) - 1)
            lo, bounds = 0, runs.offsets.to_numpy() if len(runs) else np.zeros(1, int)
            pos, n = (runs.values.field(i).to_numpy() for i in range(2))
            texts, n_words, n_removed = [], [], []
            for i, x in enumerate(batch.column(at).cast(pa.large_binary())):
                own = (x.as_py() or b"").split()
                lo, hi = (bounds[i], bounds[i + 1]) if runs[i].is_valid else (0, 0)
                kept = own
                if hi > lo:
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, pos[lo:hi], 1)
                    np.add.at(edge, pos[lo:hi] + n[lo:hi] - 1 + width, -1)
                    kept = [own[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                texts.append(b" ".join(kept) if x.is_valid else None)
                n_words.append(len(own))
                n_removed.append(len(own) - len(kept))
            out = list(batch.columns[:-1])
            out[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*batch.schema.names[:-1], "n_words", "n_removed"])

    flat_schema = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    out = joined.mapInArrow(run, T.StructType([*flat_schema, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
    return out.toDF(*docs.columns, "n_words", "n_removed")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLE = {
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
        f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN f USING (g) WHERE least < doc_id),
        x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM gone)),
        k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
}
