"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import common, language_id, line_dedup, mixing, ngram_join, packing


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """out with docs' columns, n_chars fitting the text."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out.select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or letterless texts) go; lang is the one found.
    Without any labelled text there is nothing to judge by, and all that have letters stay. An empty table stays empty.
    Every row is judged alone, with repeated ids too; all columns stay, whatever their names."""
    model = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, model)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kept = found.filter(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, and documents of which no
    line is left. Rows of one id and one text fare alike; rows of one id and different texts are
    documents of their own. Rows without an id stay as they are. All other columns stay."""
    out = line_dedup.line_dedup(docs)
    return _like(docs, out.filter("not (n_removed > 0 and n_removed = n_lines)"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component stays; all without shingles stay, and
    all without an id. Where rows share an id, all of that id stay if one of them does."""
    kept = ngram_join.ngram_join(docs).filter("component_id <=> doc_id").select("doc_id").distinct()
    unnamed = docs.filter("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).unionByName(unnamed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix draws, in the order of shards and places. A
    document without words is never drawn. Rows are drawn one by one; those that share an id, or have none, share a place in the permutation.
    An empty table stays empty; all columns stay."""
    drawn = mixing.mix(docs, carry=True).withColumn("draws", F.explode("draws"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return drawn.repartitionByRange(parts, "draws.shard", "draws.place").sortWithinPartitions("draws.shard", "draws.place").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places; a row drawn twice is packed twice. An empty
    table gives no rows."""
    found = common.materialise(packing.pieces(docs), "pieces")
    packed = packing.pack(found)
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: (name, function); each function takes (spark, docs, sf_dir).
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_near),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]
#: Suffix automata, similarity components, hashed draws and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.materialise(docs, name)
    return docs
