"""The sink of notes: what it writes, what it leaves, and what a killed task leaves."""

import json

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import notes, page_sink

START, END = "<!-- edit -->", "<!-- /edit -->"


def pages(spark, n=40, body="v1"):
    text = F.concat(F.lit(f"---\ntype: x\n---\n# {body} "), F.col("id"), F.lit(f"\n{START}\n_yours_\n{END}\ntail\n"))
    return spark.range(n).repartition(5).select(F.concat(F.lit("a b/n"), F.col("id"), F.lit(".md")).alias("rel"), text.alias("text"))


def manifest(where):
    return sorted((x["rel"], x["action"]) for f in where.glob("*.json") for x in map(json.loads, f.read_text().splitlines()))


def test_pages_are_merged(spark, tmp_path):
    vault, log = tmp_path / "vault", tmp_path / "log"
    vault.mkdir()
    page_sink.save(pages(spark), str(vault), START, END, str(log / "1"), plan=True)
    assert {a for _, a in manifest(log / "1")} == {"create"} and not list(vault.rglob("*.md"))
    page_sink.save(pages(spark), str(vault), START, END, str(log / "2"))
    assert manifest(log / "2") == manifest(log / "1") and len(list(vault.rglob("*.md"))) == 40
    one = vault / "a b" / "n3.md"
    one.write_text(one.read_text().replace("_yours_", "my own\nlines"))
    before = {f: f.stat().st_mtime_ns for f in vault.rglob("*.md")}
    page_sink.save(pages(spark), str(vault), START, END, str(log / "3"))
    assert {a for _, a in manifest(log / "3")} == {"same"} and before == {f: f.stat().st_mtime_ns for f in vault.rglob("*.md")}
    page_sink.save(pages(spark, 41, "v2"), str(vault), START, END, str(log / "4"))
    assert one.read_text() == f"---\ntype: x\n---\n# v2 3\n{START}\nmy own\nlines\n{END}\ntail\n"
    assert sorted(a for _, a in manifest(log / "4")) == ["create"] + ["update"] * 40
    assert not list((vault / ".pending").iterdir())
    found = notes.scan(spark, str(vault))
    assert found.count() == 41


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    bad = pages(spark).withColumn("text", F.when(F.col("rel").contains("n17"), F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        page_sink.save(bad, str(vault), START, END)
    assert not [f for f in vault.rglob("*") if f.is_file()]


@pytest.mark.parametrize("rel", ["../x.md", "/x.md", "a/../b.md", "", ".git/x", "a//b.md"])
def test_places_outside_the_vault(rel):
    with pytest.raises(ValueError, match="place"):
        page_sink.safe(rel)


def test_regions():
    old = f"x\n{START}\nmine\n{END}\n"
    assert page_sink.kept(f"y\n{START}\n-\n{END}\nz", old, START, END) == f"y\n{START}\nmine\n{END}\nz"
    assert page_sink.kept("y", old, START, END) == "y" and page_sink.kept("y", None, START, END) == "y" and page_sink.kept("y", old, None, None) == "y"
