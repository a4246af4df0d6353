"""An inverted index for search, as a table.

A row is a block of postings of one word (a run of characters that are no white space, as written): the least and the
greatest document number, each one's distance from the least, and how often the word stands in each. A term without white space stands only inside words, so
its occurrences in a document are those in its words, times how often these stand there: the words of the index that contain the
term are found by a scan of the dictionary, which is the word column of the blocks; where they are few, only their postings are read. A
task inverts its documents a bounded number of bytes at a time, in Arrow batches, so what is shuffled is blocks, once, and no posting by itself.
Postings are kept by hash buckets of words, each a folder, and sorted by word in it, so that buckets are pruned as partitions and row groups
by their statistics. ``add`` writes the blocks of new documents as another delta; a document that comes again replaces what it was by a
greater version.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..streaming import ingest
from . import search as S

BUCKETS = 64
#: Bytes of text that a task inverts at once; a word has one block of them, however many documents have it.
CHUNK = 16 << 20


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def inverted(ids: np.ndarray, texts: pa.Array) -> pa.Table:
    """The blocks of some documents: (word, low, high, offsets, counts). Offsets are 32 bits wide, so a word has a block for each
    range of so many numbers."""
    known, at = np.unique(ids, return_inverse=True)
    words = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = words.flatten().dictionary_encode()
    keys = coded.indices.to_numpy().astype(np.int64) * len(known) + np.repeat(at, pc.list_value_length(words).to_numpy())
    empty = coded.dictionary.index("").as_py()
    keys, counts = np.unique(keys[keys // len(known) != empty] if empty >= 0 else keys, return_counts=True)
    code, ids = keys // len(known), known[keys % len(known)]
    first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(ids >> 31, prepend=0) != 0))
    ends = np.append(first, len(keys))
    offsets = ids - np.repeat(ids[first], np.diff(ends))
    cut = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
    return pa.table({"word": coded.dictionary.take(pa.array(code[first])).cast(pa.string()), "low": ids[first], "high": ids[ends[1:] - 1], "offsets": cut(offsets), "counts": cut(counts)})


def _inverting(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.nbytes
            if size >= chunk:
                yield from invert(held)
                held, size = [], 0
        yield from invert(held)

    def invert(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            docs = pa.Table.from_batches(held)
            yield from inverted(docs["id"].to_numpy(), docs["text"].combine_chunks()).to_batches(1 << 16)

    return run


def blocks(notes: DataFrame, key: str = "id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Postings as blocks: (bucket, word, low, high, offsets, counts). A word that every document has is many blocks
    of bounded size."""
    rows = notes.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    cut = rows.mapInArrow(_inverting(chunk), "word string, low long, high long, offsets array<int>, counts array<int>")
    return cut.select(_bucket(F.col("word")).alias("bucket"), "*")


def add(notes: DataFrame, path: str, version: int, key: str = "id", text: str = "text") -> None:
    """Write the blocks of these documents, and which documents they are, as delta ``version``, which is whole or
    (without Spark's mark of success) isn't read; writing it again replaces it."""
    ship(notes.sparkSession)
    rows = blocks(notes, key, text).repartitionById(BUCKETS, F.col("bucket"))  # a bucket is a task: hashed again, some tasks had several
    rows.sortWithinPartitions("bucket", "word", "low").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/v={version}")
    notes.select(F.col(key).cast("long").alias("id")).write.mode("overwrite").parquet(f"{path}/documents/v={version}")


def _containing(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The rows whose word contains a term, in any case, with ``times``, how often."""
    any_term = "|".join(map(re.escape, terms)) or "(?!)"
    return rows.filter(F.col("word").rlike("(?i)" + any_term)).withColumn("times", S.hits(F.col("word"), terms))


def dictionary(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(bucket, word, times): the words that contain a term, in any case, and how often; one scan for all terms."""
    return _containing(ingest.versions(spark, f"{path}/postings").select("bucket", "word"), terms).distinct()


def hits(spark: SparkSession, path: str, terms: list[str], most_words: int = 10_000) -> DataFrame:
    """(id, hits) of the documents in which a term stands, as search.hits counts them; no term may have white
    space. The index' own folder prunes: words found in the dictionary are, up to most_words of them, a list in the scan of
    the postings; beyond, that scan tells the words itself."""
    if any(re.search(r"[\x20\x09-\x0D]", t) for t in terms):
        raise ValueError("the index has words: a term with white space is counted in the texts")
    known = dictionary(spark, path, terms).limit(most_words + 1).collect()
    deltas = ingest.versions(spark, f"{path}/postings")
    if len(known) <= most_words:
        deltas = deltas.filter(F.col("bucket").isin(sorted({r.bucket for r in known})) & F.col("word").isin(sorted({r.word for r in known})))
        rows = deltas.join(F.broadcast(spark.createDataFrame(known, "bucket int, word string, times long")), ["bucket", "word"])
    else:
        rows = _containing(deltas, terms)
    numbers = F.transform("offsets", lambda o: F.col("low") + o)
    found = rows.select("v", "times", F.inline(F.arrays_zip(numbers.alias("id"), F.col("counts").alias("n")))).groupBy("v", "id").agg(F.sum(F.col("n") * F.col("times")).alias("hits"))
    newest = ingest.versions(spark, f"{path}/documents").groupBy("id").agg(F.max("v").alias("v"))
    return found.join(newest, ["id", "v"]).select("id", "hits")


def search(notes: DataFrame, path: str, terms: list[str], key: str = "id", **law) -> DataFrame:
    """search.search over notes (key, rel, stem, source): same rows, hits from the index, no text is read."""
    found = hits(notes.sparkSession, path, terms)
    return S.ranked(notes.join(found, notes[key] == found["id"]).drop(found["id"]), **law)
