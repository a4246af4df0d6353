"""Greedy pairs in rounds, against the sequential rule."""

import datetime as dt
import random

import pytest

from corpusflow.operators import matching
from corpusflow.plans import catalogue

START = dt.datetime(2024, 1, 1)


def sequential(left, right, seconds):
    free, out = dict(right), set()
    for _, i, t in sorted((o, i, t) for i, t, o in left if t is not None):
        near = [(abs(u - t), k) for k, u in free.items() if u is not None and abs(u - t) <= seconds]
        if near:
            k = min(near)[1]
            out.add((i, k))
            del free[k]
    return out


def pairs(spark, left, right, seconds):
    at = lambda t: None if t is None else START + dt.timedelta(seconds=t)
    a = spark.createDataFrame([(i, at(t), o) for i, t, o in left], "id long, start timestamp, ordinal long").repartition(4)
    b = spark.createDataFrame([(i, at(t)) for i, t in right], "id long, start timestamp").repartition(3)
    return [(r.left_id, r.right_id) for r in matching.greedy_pairs(a, b, seconds).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_random_rows(spark, seed):
    r = random.Random(seed)
    span, seconds = [(400, 10), (3000, 30), (1, 0), (60, 4)][seed]
    left = [(i, r.randint(0, span), r.randint(0, 30)) for i in range([120, 120, 120, 40][seed])] + [(900, None, 0)]
    right = [(i, r.randint(0, span)) for i in range([150, 90, 60, 60][seed])] + [(900, None)]
    got = pairs(spark, left, right, seconds)
    assert len(got) == len(set(got)) and set(got) == sequential(left, right, seconds)


@pytest.mark.parametrize(("seed", "block"), [(0, 40), (1, 60), (2, 25), (3, 7), (4, 64)])
def test_blocks_settle_what_stands_without_their_neighbours(spark, monkeypatch, seed, block):
    """Rows in many blocks: the rounds of proposals get few of them or none."""
    r = random.Random(seed)
    span, seconds = [(4000, 10), (3000, 3), (900, 2), (60, 4), (9000, 30)][seed]
    left = [(i, r.randint(0, span), [i, r.randint(0, 30)][seed % 2]) for i in range(300)]
    right = [(i, r.randint(0, span)) for i in range([300, 200, 400, 100, 350][seed])]
    at = lambda t: START + dt.timedelta(seconds=t)
    a = spark.createDataFrame([(f"l{i}", at(t), o) for i, t, o in left], "id string, start timestamp, ordinal long")
    b = spark.createDataFrame([(f"r{i:03}", at(t)) for i, t in right], "id string, start timestamp")
    rest, proposed = [], matching._proposed
    monkeypatch.setattr(matching, "_proposed", lambda lefts, *more: rest.append(lefts.count()) or proposed(lefts, *more))
    got = {(x.left_id, x.right_id) for x in matching.greedy_pairs(a, b, seconds, "string", block=block).collect()}
    order = sorted(left, key=lambda x: (x[2], f"l{x[0]}"))
    want = sequential([(i, t, k) for k, (i, t, _) in enumerate(order)], right, seconds)
    assert got == {(f"l{i}", f"r{k:03}") for i, k in want}
    assert seed == 3 or sum(rest) < 60


def test_events_every_second_over_several_spans(spark):
    """No gap anywhere: islands would be one group of all rows."""
    n, seconds = 600, 30
    left, right = [(i, i, n - i) for i in range(n)], [(i, i + 7) for i in range(0, n, 2)]
    assert set(pairs(spark, left, right, seconds)) == sequential(left, right, seconds)


def test_one_second_holds_most_rows(spark):
    left = [(i, 100, i) for i in range(2000)] + [(5000 + i, 101 + i % 3, 3000 + i) for i in range(9)]
    right = [(i, 100) for i in range(1500)] + [(3000 + i, 99) for i in range(495)]
    assert set(pairs(spark, left, right, 10)) == sequential(left, right, 10)


def test_no_rows(spark):
    assert pairs(spark, [], [(1, 5)], 3) == [] and pairs(spark, [(1, 5, 0)], [], 3) == []


@pytest.mark.parametrize("name", ["greedy_merge", "meeting_merge"])
def test_no_python_groups(spark, name):
    assert "FlatMapGroupsInPandas" not in catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_nearest_makes_no_pairs_but_the_answers(spark):
    """Many records of few seconds: each row has its nearest one, and no operator's rows are those of all pairs."""
    r = random.Random(7)
    left, right = [(i, r.randint(-40, 60)) for i in range(900)], [(["x", "y", None][i % 3], i, r.randint(-40, 90)) for i in range(900)]
    at = lambda t: START + dt.timedelta(seconds=t)
    a = spark.createDataFrame([(i, at(t)) for i, t in left], "id long, start timestamp")
    b = spark.createDataFrame([(s, i, at(t)) for s, i, t in right], "source string, id long, start timestamp")
    near = matching.nearest_within(a, b, 7)
    want = {}
    for i, t in left:
        for s, k, u in right:
            if abs(t - u) <= 7:
                want[i, s] = min(want.get((i, s), (99, 0)), (abs(t - u), k))
    assert {(x.id, x.source): (x.gap, x.match) for x in near.collect()} == want
    assert max(_rows(near)) < 5 * 900


def _rows(df):
    """Numbers of output rows of the operators of a plan that ran."""
    out, waiting = [], [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            waiting.append(node.plan())
            continue
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            out.append(found.get().value())
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return out
