"""Many patterns at once: against brute force, and what the plans look like."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import patterns
from corpusflow.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows_of(spark, n=300, seed=5):
    r = random.Random(seed)
    alphabet = "abcd eé ıKß中.-"
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 100, 3000]))) for _ in range(n)] + [None, ""]
    terms = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(3, 12))) for _ in range(5200)})
    return texts, terms


def test_five_thousand_terms(spark):
    texts, terms = rows_of(spark)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    known = spark.createDataFrame([(t,) for t in terms], "term string")
    found = patterns.join(rows, "text", known, F.array("term"), F.contains(F.lower("text"), F.lower("term")), most=1 << 20)
    assert len(terms) >= 5000 and "NestedLoop" not in found._jdf.queryExecution().toString()
    want = {(i, t) for i, x in enumerate(texts) for t in terms if x is not None and t.lower() in x.lower()}
    assert {(r.id, r.term) for r in found.select("id", "term").collect()} == want


def test_texts_longer_than_pieces_and_literals_longer_than_texts(spark):
    words = ["x" * n for n in (1, 2, 511, 512, 513, 2000)]
    texts = ["y" * 500 + "x" * n + "y" * 700 for n in (0, 1, 3, 511, 513, 1999, 2000)]
    found = patterns.join(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", spark.createDataFrame([(w,) for w in words], "term string"), F.array("term"), F.contains("text", F.col("term")))
    assert {(r.id, len(r.term)) for r in found.select("id", "term").collect()} == {(i, len(w)) for i, t in enumerate(texts) for w in words if w in t}


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        (r"(?i)widget|bolt", ["bolt", "widget"]), (r"(?iU)\b(?:\Qa.b c\E|\Qthe best\E)\b", ["a.b c", "the best"]), (r"foo(?:bar)?baz", ["foo"]), (r"(abc|de)f", ["abc", "de"]), (r"colou?r\s+me", ["colo"]),
        (r"a+b", None), (r"x|", None), (r"(?:ab)?", None), (r"\x41bcd", None), (r"\p{Lu}ord", ["ord"]), (r"[a[bc]]dd", None), (r"(?<!no )yes", ["yes"]), (r"hel{2}o", ["hel"]), (r"\bk8s\b", ["k8s"]),
    ],
)
def test_required_literals(pattern, literals):
    assert patterns.required(pattern) == literals


def test_required_literals_stand_in_every_match():
    r = random.Random(9)
    for _ in range(3000):
        pattern = "".join(r.choice(["a", "b", "c", "ab", "(ab|c)", "(?:bc)?", "[ab]", "a*", "b+", "|", r"\b", ".", "c{2}"]) for _ in range(r.randint(1, 6)))
        literals = patterns.required(pattern)
        text = "".join(r.choice("abc") for _ in range(12))
        m = re.search(pattern, text)
        if literals and m:
            assert any(x in m[0] for x in literals), (pattern, text)


def test_patterns_without_literals_are_tried_on_all_rows(spark):
    rows = spark.createDataFrame([(1, "aab"), (2, "widget A"), (3, None)], "id long, text string")
    known = spark.createDataFrame([("p", "a+b", None), ("q", "(?i)WIDGET", ["widget"])], "name string, pattern string, literals array<string>")
    found = patterns.join(rows, "text", known, F.col("literals"), F.expr("text rlike pattern"))
    assert sorted((r.id, r.name) for r in found.collect()) == [(1, "p"), (2, "q")]


@pytest.mark.parametrize("name", ["raw_evidence", "evidence_bundles", "entity_mentions", "project_mentions"])
def test_plans_have_no_nested_loop(spark, name):
    assert "NestedLoop" not in catalogue.queries()[name](spark, SF)._jdf.queryExecution().toString()
