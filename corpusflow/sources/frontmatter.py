"""Frontmatter, the small YAML subset at a note's head, as map<string, array<string>>.

Dialects: ``fenced`` (closing fence and a line feed), ``loose`` (the first closing fence
after the opening one, also at the text's end), ``flat`` (each line with a colon is a
key, no lists), ``probe`` (wanted keys in the first lines, the last one wins), ``raw``
(the block's lines). One pass of SQL functions, no UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCED = r"(?s)^---\n(.*?)\n---\n"
LOOSE = r"(?s)^---[^\n]*\n(.*?)\n?---(?:\n|\z)"


def block(text: Column, dialect: str = "fenced") -> Column:
    """The lines between the fences; null without frontmatter."""
    pattern = LOOSE if dialect == "loose" else FENCED
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def body(text: Column) -> Column:
    return F.regexp_replace(text, FENCED, "")


def _unquote(c: Column) -> Column:
    c = F.trim(c)
    same = (F.length(c) >= 2) & (F.substring(c, 1, 1) == F.substring(c, -1, 1)) & F.substring(c, 1, 1).isin("'", '"')
    return F.when(same, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(F.nullif(c, F.lit("")))


def parse(text: Column, dialect: str = "fenced") -> Column:
    """key -> values; an empty value is an empty array. A later key wins."""
    lines = F.filter(F.split(F.coalesce(block(text, dialect), F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("#")))
    if dialect == "flat":
        pairs = F.transform(
            F.filter(lines, lambda x: x.contains(":")),
            lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.array(F.trim(F.regexp_replace(x, "^[^:]*:", ""), F.lit(" '\""))).alias("v")),
        )
        return F.map_from_entries(_last(pairs))
    key, item = r"^([^:\s][^:]*):(.*)$", r"^\s*-\s+(.*)$"
    none = F.array().cast("array<string>")
    state = F.struct(F.array().cast("array<struct<k:string,v:array<string>>>").alias("done"), F.lit(None).cast("string").alias("k"), none.alias("v"), F.lit(False).alias("open"))

    def value(rest: Column) -> Column:
        inner = F.transform(F.split(F.regexp_extract(rest, r"^\[(.*)\]$", 1), ","), _unquote)
        return F.when(rest.rlike(r"^\[.*\]$"), F.filter(inner, lambda x: x.isNotNull())).otherwise(F.filter(F.array(_unquote(rest)), lambda x: x.isNotNull()))

    def step(a: Column, line: Column) -> Column:
        rest = F.trim(F.regexp_extract(line, key, 2))
        flush = F.when(a["k"].isNotNull(), F.concat(a["done"], F.array(F.struct(a["k"].alias("k"), a["v"].alias("v"))))).otherwise(a["done"])
        new = F.struct(flush.alias("done"), F.trim(F.regexp_extract(line, key, 1)).alias("k"), value(rest).alias("v"), (rest == "").alias("open"))
        more = F.struct(a["done"].alias("done"), a["k"].alias("k"), F.concat(a["v"], F.array(_unquote(F.regexp_extract(line, item, 1)))).alias("v"), a["open"].alias("open"))
        return F.when(line.rlike(item) & a["open"], more).when(line.rlike(key), new).otherwise(a)

    pairs = F.aggregate(lines, state, step, lambda a: F.when(a["k"].isNotNull(), F.concat(a["done"], F.array(F.struct(a["k"].alias("k"), a["v"].alias("v"))))).otherwise(a["done"]))
    return F.map_from_entries(_last(pairs))


def _last(pairs: Column) -> Column:
    """Without pairs whose key comes again."""
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))


def probe(text: Column, keys: Iterable[str], lines: int = 51) -> Column:
    """key -> value of wanted keys in the first lines, outer double quotes stripped."""
    head = F.slice(F.split(text, "\n"), 1, lines)
    starts = lambda k: lambda x: F.startswith(x, F.lit(f"{k}:"))
    out = []
    for k in keys:
        found = F.filter(head, starts(k))
        out += [F.lit(k), F.trim(F.trim(F.substring(F.try_element_at(found, F.lit(-1)), len(k) + 2, 1 << 20)), F.lit('"'))]
    return F.map_filter(F.create_map(*out), lambda _, v: v.isNotNull())


def scalar(fm: Column, key: str) -> Column:
    """The first value of a key; null where there is none."""
    return F.try_element_at(F.try_element_at(fm, F.lit(key)), F.lit(1))


def values(fm: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(fm, F.lit(key)), F.array().cast("array<string>"))


def set_scalar(text: Column, key: str, value: Column) -> Column:
    """text with a scalar of its frontmatter set, or added as the last line of the block."""
    line = F.concat(F.lit(f"{key}: "), value)
    literal = F.regexp_replace(line, r"([\\$])", r"\\$1")
    has = block(text).rlike(rf"(?m)^{key}:.*$")
    put = F.regexp_replace(text, F.lit(rf"(?s)\A(---\n(?:(?!---\n).*?\n)?){key}:[^\n]*"), F.concat(F.lit("$1"), literal))
    add = F.regexp_replace(text, F.lit(r"(?s)\A(---\n.*?\n)---\n"), F.concat(F.lit("$1"), literal, F.lit("\n---\n")))
    return F.when(block(text).isNull(), text).when(has, put).otherwise(add)


def add_tag(text: Column, tag: str) -> Column:
    """text with a tag: in an inline list, as the first item of a block list, or as a new list."""
    fm = parse(text)
    inline = F.regexp_replace(text, r"(?m)\A((?s:---\n.*?))^tags: *\[(.*?)\]", f"$1tags: [$2, {tag}]")
    blocky = F.regexp_replace(text, r"(?m)\A((?s:---\n.*?))^tags: *$", f"$1tags:\n- {tag}")
    single = F.regexp_replace(text, r"(?m)\A((?s:---\n.*?))^tags: *([^\[\n ][^\n]*)$", f"$1tags: [$2, {tag}]")
    inner = block(text)
    return (
        F.when(inner.isNull(), F.concat(F.lit(f"---\ntags: [{tag}]\n---\n\n"), text))
        .when(F.array_contains(values(fm, "tags"), tag), text)
        .when(inner.rlike(r"(?m)^tags: *\[\s*\]"), F.regexp_replace(text, r"(?m)\A((?s:---\n.*?))^tags: *\[\s*\]", f"$1tags: [{tag}]"))
        .when(inner.rlike(r"(?m)^tags: *\["), inline)
        .when(inner.rlike(r"(?m)^tags: *$"), blocky)
        .when(inner.rlike(r"(?m)^tags:"), single)
        .otherwise(set_scalar(text, "tags", F.lit(f"[{tag}]")))
    )
