"""The inverted index against scans, and a polled service's cursor."""

import collections
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import index, search
from corpusflow.streaming import ingest, polling


def notes(spark, texts):
    rows = [(i, f"raw/s{i % 3}/n{i}.md" if i % 2 else f"20 - Projects/n{i}.md", f"n{i}", f"s{i % 3}", t) for i, t in texts.items()]
    return spark.createDataFrame(rows, "id long, rel string, stem string, source string, text string")


def test_index_counts_as_a_scan_does(spark, tmp_path):
    texts = {i: t for i, t in enumerate(["aaa aaaa", "The the\tTHE\nthe.", None, "", "x.y(z) x.y(z)", "breathe the", "é thé", "other"] * 3)} | {9000: "far the", 10**12: "the end"}
    df, path = notes(spark, texts), str(tmp_path / "index")
    index.add(df.filter("id % 2 = 0"), path, 0)
    index.add(df.filter("id % 2 = 1"), path, 1)
    for terms in (["the"], ["aa", "x.y(z)"], ["é", "HE"], ["nothing"]):
        want = {r.id: r.n for r in df.withColumn("n", search.hits(F.col("text"), terms)).filter("n > 0").collect()}
        assert {r.id: r.hits for r in index.hits(spark, path, terms).collect()} == want
        assert {r.id: r.hits for r in index.hits(spark, path, terms, most_words=0).collect()} == want
    index.add(notes(spark, {1: "nothing here", 9000: "the the"}), path, 2)
    assert {r.id: r.hits for r in index.hits(spark, path, ["the"]).filter("id in (1, 9, 9000)").collect()} == {9: 4, 9000: 2}
    with pytest.raises(ValueError, match="white space"):
        index.hits(spark, path, ["two words"])


def test_index_reads_only_buckets_with_the_words(spark, tmp_path):
    df, path = notes(spark, {i: f"word{i} common" for i in range(300)}), str(tmp_path / "index")
    index.add(df, path, 0)
    found = index.hits(spark, path, ["word299"])
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert re.search(r"PushedFilters: \[[^]]*word", plan) and re.search(r"PartitionFilters: \[[^]]*bucket", plan)
    assert [r.id for r in found.collect()] == [299]
    assert sorted((r.rel, r.hits) for r in index.search(df, path, ["word17", "word170"]).collect()) == sorted((r.rel, r.hits) for r in search.search(df, ["word17", "word170"]).collect())


def explained(spark, df):
    return spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_postings_are_inverted_in_tasks_and_terms_found_in_one_scan(spark, tmp_path):
    df, path = notes(spark, {i: f"the{i} other common" for i in range(300)}), str(tmp_path / "index")
    assert "Exchange" not in explained(spark, index.blocks(df))
    index.add(df, path, 0)
    assert explained(spark, index.dictionary(spark, path, ["the", "oth", "nothing"])).count("FileScan") == 1
    many = index.hits(spark, path, ["the"], most_words=10)
    assert explained(spark, many).count("Join") == 1  # with the documents, not with the words
    assert sorted((r.id, r.hits) for r in many.collect()) == [(i, 2) for i in range(300)]
    assert index.hits(spark, path, []).collect() == []


def test_blocks_of_chunks(spark):
    rows = [(7, "b a b"), (3, "a\x0ba a\x85 "), (None, "a"), (3, "a"), (5, None), (-2, "a \x1c"), (2**31, "a"), (2**40, ""), (6, " \t\r\n")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        parts, whole = index.blocks(df, chunk=1).collect(), index.blocks(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for got in (parts, whole):
        n = collections.Counter()
        for r in got:
            assert r.offsets[0] == 0 and r.low + r.offsets[-1] == r.high and list(r.offsets) == sorted(set(r.offsets))
            n.update({(r.word, r.low + o): c for o, c in zip(r.offsets, r.counts, strict=True)})
        assert n == {("a", 7): 1, ("b", 7): 2, ("a", 3): 3, ("a\x85", 3): 1, ("a", -2): 1, ("\x1c", -2): 1, ("a", 2**31): 1}
    assert [len(r.offsets) for r in parts] == [1] * 8
    assert sorted((r.low, r.high) for r in whole if r.word == "a") == [(-2, -2), (3, 7), (2**31, 2**31)]


def test_windows():
    cut = polling.windows("2024-01-10T00:00:00", "2024-01-12T12:00:00", 24, 48)
    assert [(w.lo, w.hi, w.last) for w in cut] == [("2024-01-09T00:00:00", "2024-01-11T00:00:00", False), ("2024-01-11T00:00:00", "2024-01-12T12:00:00", True)]
    assert [(w.lo, w.last) for w in polling.windows("", "2024-01-12T12:00:00", 24, 48)] == [(None, True)]
    one = polling.windows("2024-01-10T00:00:00", "2024-01-10T00:00:00", 0, 48)
    assert len(one) == 1 and one[0].last


def test_polling_twice(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = lambda ids: spark.createDataFrame([(i, day + dt.timedelta(hours=i)) for i in ids], "id long, ts timestamp_ntz")
    seen = []

    def each(batch, number):
        if ids := sorted(r.id for r in batch.collect()):  # a stream's first batch may be empty
            seen.append(ids)

    def poll():
        stream = polling.poll(spark, str(tmp_path / "service"), "id long, ts timestamp_ntz", "ts", overlap_hours=2, window_hours=24)
        ingest.run(stream, each, str(tmp_path / "checkpoint"))

    (tmp_path / "service").mkdir()
    poll()
    assert seen == []  # nothing there: no batch, no cursor
    rows(range(100)).write.parquet(str(tmp_path / "service" / "a"))
    poll()
    assert seen == [list(range(100))]
    poll()
    assert len(seen) == 1  # nothing newer: the cursor stays
    rows([98, 100, 130]).write.parquet(str(tmp_path / "service" / "b"))
    poll()
    assert seen[1] == sorted([97, 98, 98, 99, 100, 130])  # from two hours before the cursor on
