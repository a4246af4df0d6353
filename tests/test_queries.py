"""Every query with SQL is held against DuckDB on the smallest tables."""

import datetime as dt
import decimal
from functools import cache

import duckdb
import pytest

from corpusflow.plans import catalogue
from corpusflow.sources.views import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    def tables(sf):
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        return db

    return cache(tables)


#: Queries whose hard cases (people who share a file, long chains) need more rows than the smallest tables have.
LARGER = ("people_plan", "people_collisions", "people_tiers", "greedy_merge", "token_overlap_classes", "exactly_one_link")


@pytest.mark.parametrize(("name", "sf"), [(n, SF) for n in sorted(catalogue.queries())] + [(n, "/root/testdata/sf0.01") for n in LARGER])
def test_query(spark, duck, name, sf):
    duck = duck(sf)
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    at = [[d[0] for d in got.description].index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
