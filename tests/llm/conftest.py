import random

import pytest
from pyspark.sql import types as T

#: names of columns that an operator might add on the way
HIDDEN = ("__at", "__gone", "__node", "__weight", "__tie", "__p0", "__key", "__runs", "version", "gone", "runs", "doc", "doc_text", "at", "lines", "c0", "c1", "tie", "weight")
FULL = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
        # extra columns whose names the operators use themselves
        ("key", T.StringType()), ("node", T.LongType()), ("n", T.LongType()), ("size", T.LongType()), ("pos", T.StringType()), ("shard", T.StringType()), ("slot", T.LongType()),
        ("digest", T.LongType()), ("lang_pred", T.StringType()), ("score", T.StringType()), ("n_words", T.StringType()), ("n_lines", T.StringType()), ("__lines", T.StringType()), ("draws", T.StringType()), ("target", T.StringType()),
        *((n, T.StringType()) for n in HIDDEN),
    )]
)
WORDS = {"en": "the of and in her that with was there thing".split(), "fr": "le de et dans elle que avec être là chose".split(), "de": "der von und in ihr dass mit war dort ding".split()}


def body(seed: int, n: int, lang: str = "en") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "er", "ing", "n", "ot", "a"]) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, copies and repeated rows."""
    base = body(1, 120)
    lines = "\n".join(body(i, 9) for i in range(40, 46))
    texts = [
        base, base, base.upper(), base.replace("the", "xx", 1), "  " + base.replace(" ", "\n", 3) + "\t", None, "", " \n\t ", "...", "one", "one two", "One TWO",
        body(2, 30, "fr"), body(3, 60, "de"), body(4, 20000), "x" * 70000, lines, "intro line\n" + lines + "\n\nlast", "a\na\na\na\na", "ß É Σ İ 中文 \U0001f600 <|endoftext|> é don't.",
        body(5, 60) + "\n" + body(6, 55), body(7, 10) + " " + body(6, 55) + " " + body(8, 3), "Released under the MIT License.", None,
    ]
    out = [(i, t, ["en", "fr", None, "de"][i % 4] if i not in (12, 13) else ["fr", "de"][i - 12], [f"s{i % 3}", None][i % 5 == 4], len(t or ""), *[None] * 15, *["mine"] * len(HIDDEN)) for i, t in enumerate(texts)]
    out += [(100 + i, body(200 + i, 40, l), l, "hot", 1, "k", 1, 1, 1, "p", "s", 1, 1, "l", "s", "w", "l", "l", "d", "t", *["mine"] * len(HIDDEN)) for i, l in enumerate(["en", "fr", "de"] * 20)]
    again = [(k, t, *out[k][2:]) for k, t in ((0, lines + "\nown"), (4, body(6, 55) + " tail"), (17, lines + "\nother"), (17, base), (20, None), (21, ""))]
    return [*out, out[0], out[30], out[17], *again]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), FULL).repartition(4).cache()


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([tuple([None] * len(FULL)), tuple([None] * len(FULL)), (1, "a b c d e f", *[None] * (len(FULL) - 2))], FULL)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], FULL)
