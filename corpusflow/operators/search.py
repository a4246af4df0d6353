"""Layered keyword search with capped layers, and the citation gate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: A layer's rows in the answer.
CAPS = {"synthesis": 99, "concept": 99, "index": 5, "dashboard": 6, "entity": 10, "people": 8, "para": 12, "daily": 5, "clippings": 5, "inbox": 5, "archive": 4, "raw": 15, "other": 8}
RAW_PER_SOURCE = 5
#: Path prefix, layer, weight; the first that fits holds.
LAYERS = (
    ("wiki/synthesis", "synthesis", 5.0), ("wiki/concepts", "concept", 4.0), ("wiki/index.md", "index", 4.5), ("60 - Meta/MOCs", "index", 4.5),
    ("wiki/entities", "entity", 3.0), ("60 - Meta/Dashboards", "dashboard", 2.5), ("50 - CRM/People", "people", 2.2), ("20 - Projects", "para", 2.0),
    ("30 - Areas", "para", 2.0), ("40 - Resources", "para", 2.0), ("60 - Meta", "para", 1.8), ("70 - Daily", "daily", 1.5), ("80 - Clippings", "clippings", 1.2),
    ("10 - Inbox", "inbox", 1.0), ("raw", "raw", 1.0), ("90 - Archive", "archive", 0.5),
)


def layer(rel: Column, rules=LAYERS) -> Column:
    """struct(layer, weight) of a path."""
    pick = lambda i, rest: F.when(F.startswith(rel, F.lit(rules[i][0])), _layer(*rules[i][1:])).otherwise(rest)
    out = _layer("other", 1.0)
    for i in reversed(range(len(rules))):
        out = pick(i, out)
    return out


def _layer(name: str, weight: float) -> Column:
    return F.struct(F.lit(name).alias("layer"), F.lit(weight).alias("weight"))


def hits(c: Column, terms: list[str], mode: str = "occurrences") -> Column:
    """How often the terms occur, in any case; or, by lines, how many lines match any term."""
    if mode == "lines":
        return F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike("(?i)" + "|".join(terms)))).cast("long")
    n = F.lit(0)
    for t in terms:
        n = n + F.regexp_count(c, F.lit("(?i)" + re.escape(t)))
    return n.cast("long")


def search(notes: DataFrame, terms: list[str], rules=LAYERS, caps: dict[str, int] = CAPS, raw_per_source: int = RAW_PER_SOURCE, mode: str = "occurrences") -> DataFrame:
    """notes (rel, stem, source, text) -> (rel, stem, layer, hits, score), capped by layer
    and, in raw, by source; best score, then hits, then path. Every text is scanned; ``index.search`` gives the same rows from
    an inverted index."""
    return ranked(notes.withColumn("hits", hits(F.col("text"), terms, mode)).filter("hits > 0"), rules, caps, raw_per_source)


def ranked(rows: DataFrame, rules=LAYERS, caps: dict[str, int] = CAPS, raw_per_source: int = RAW_PER_SOURCE) -> DataFrame:
    """rows (rel, stem, source, hits) as search gives them."""
    rows = rows.withColumn("__l", layer(F.col("rel"), rules))
    rows = rows.select("rel", "stem", "source", "hits", F.col("__l.layer").alias("layer"), F.round(F.col("hits") * F.col("__l.weight"), 2).alias("score"))
    best = [F.desc("score"), F.desc("hits"), F.asc("rel")]
    # ranks are bounded by constants first: each task keeps its own best rows before the shuffle
    # (WindowGroupLimit), so no task sorts all hits of a layer
    raw = rows.filter("layer = 'raw'").withColumn("__s", F.row_number().over(W.partitionBy("source").orderBy(*best))).filter(F.col("__s") <= raw_per_source).drop("__s")
    rest = rows.filter("layer <> 'raw'")
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("layer")), F.lit(caps["other"]))
    first = raw.unionByName(rest).withColumn("__n", F.row_number().over(W.partitionBy("layer").orderBy(*best))).filter(F.col("__n") <= max(caps.values()))
    return first.filter(F.col("__n") <= cap).drop("__n", "source")


def hubs(terms: list[str], pages: DataFrame) -> DataFrame:
    """pages (kind, slug) that a term names."""
    keys = [re.sub("[^a-z0-9]", "", t.lower()) for t in terms]
    return pages.filter(T.fuzzy_key(F.col("slug")).isin(*keys))


def citations(answers: DataFrame, stems: DataFrame) -> DataFrame:
    """answers (id, text), stems (stem) -> (id, cited, resolved): each distinct wikilink and
    whether a note has that name, in any case."""
    cited = answers.select("id", F.explode(F.array_distinct(F.transform(T.extract(F.col("text"), T.WIKILINK), lambda x: F.trim(x)))).alias("cited"))
    known = stems.select(F.lower("stem").alias("__k")).distinct()
    return cited.join(known, F.lower("cited") == F.col("__k"), "left").select("id", "cited", F.col("__k").isNotNull().alias("resolved"))
