"""Line state in time that grows with the lines, and overlaps without all their pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import threads


def fenced(body):
    out, inside = [], False
    for x in body.replace("\r\n", "\n").split("\n"):
        mark = x.lstrip(" ").startswith("```")
        out.append((x, inside or mark))
        inside ^= mark
    return out


def test_fenced_lines(spark):
    r = random.Random(1)
    bodies = ["\n".join(r.choice(["", "a", "# h", "```", "  ```py", "\t```", "x ```", " "]) for _ in range(r.randint(0, 12))) for _ in range(300)] + ["", "\n", "```", "```\n", "\n```", "a\r\n```\r\nb"]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string").select("id", T._fenced_lines(F.col("body")).alias("l")).collect()
    assert {x.id: [(y.x, y.fenced) for y in x.l] for x in got} == {i: fenced(b) for i, b in enumerate(bodies)}


def test_hundred_thousand_lines(spark):
    body = "\n".join("```" if i % 50 == 0 else f"# head {i}" if i % 7 == 0 else "- item" for i in range(100_000))
    df = spark.createDataFrame([(body,)], "body string")
    df.select(T.next_steps(F.lit("a"))).collect()
    began = time.perf_counter()
    (row,) = df.select(F.size(T._fenced_lines(F.col("body"))).alias("n"), F.length(T.spine(F.col("body"))).alias("s")).collect()
    assert row.n == 100_000 and row.s > len(body) and time.perf_counter() - began < 20


def pairs(slugs):
    tokens = {s: {t for t in s.split("-") if len(t) >= 3} for s in slugs}
    return sorted((a, b, sorted(tokens[a] & tokens[b])) for a in slugs for b in slugs if a < b and tokens[a] & tokens[b])


@pytest.mark.parametrize("most_tokens", [14, 2])
def test_overlaps(spark, most_tokens):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "zeta", "own1", "own2"]
    slugs = sorted({"-".join(r.sample(words, r.randint(1, 5))) for _ in range(150)})
    df = spark.createDataFrame([(s,) for s in slugs], "slug string").repartition(4)
    want = pairs(slugs)
    assert threads.overlaps_total(df, (), most_tokens).collect()[0].n == len(want)
    assert [(x.a, x.b, sorted(x.shared)) for x in threads.first_overlaps(df, 25, ()).collect()] == want[:25]
    classes = threads.token_classes(df, ()).collect()
    assert {(x.token, x.slug) for x in classes} == {(t, s) for a, b, ts in want for t in ts for s in (a, b)}
    assert sorted((x.a, x.b, sorted(x.shared)) for x in threads.token_overlap(df, ()).collect()) == want


def test_a_token_of_a_hundred_thousand_slugs(spark):
    df = spark.range(100_000).select(F.format_string("s%06d-shared", "id").alias("slug"))
    n = 100_000
    assert threads.overlaps_total(df).collect()[0].n == n * (n - 1) // 2
    assert [(x.a, x.b) for x in threads.first_overlaps(df, 25).collect()] == [("s000000-shared", f"s{i:06d}-shared") for i in range(1, 26)]
    assert threads.token_classes(df).filter(f"links = {n * (n - 1) // 2}").count() == n
    assert threads.overlaps_total(df.limit(0)).collect()[0].n == 0
