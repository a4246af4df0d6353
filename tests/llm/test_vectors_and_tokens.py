"""op11, op12 and op13: odd rows against brute force, and their parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm import common, packing, token_files, vector_codes, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]
    # extra columns whose names the operators use themselves
    + [T.StructField(n, T.StringType()) for n in ("key", "vector", "x", "code", "error", "hot", "cold", "rows", "n", "component", "part", "entry", "dim", "node", "explained")]
)
EXTRA = ["mine"] * 15


def odd_rows(n=60, dims=16, seed=4):
    r = random.Random(seed)
    rows = [(i, [np.float32(r.gauss(0, 0.3)).item() for _ in range(dims)], r.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows += [(rows[3][0], rows[3][1], 5), rows[4], (7, rows[9][1], 1), (None, rows[5][1], None), (None, [0.25] * dims, 2), (900, [-0.0] * dims, 0), (901, [1e-30, -1e-30] * (dims // 2), 0)]
    bad = [None, [], [0.5] * (dims - 1) + [None], [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [1.0] * (dims + 8), [3e38] * dims]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)]
    return [(*row, *EXTRA) for row in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def usable(rows, scale, dims=16):
    out = []
    for k, v, label, *_ in rows:
        if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v) and max(map(abs, v)) < 1e30:
            out.append((k, [int(np.floor(float(np.float32(c)) * scale)) for c in v], label))
    return out


def quantised(rows, parts=8, entries=16, rounds=6):
    """The contract's rounds, one integer at a time."""
    length = len(rows[0][1]) // parts
    start = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * length : (p + 1) * length] for r in start] for p in range(parts)]
    cut = [[r[1][p * length : (p + 1) * length] for p in range(parts)] for r in rows]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut:
                groups[near(x[p], books[p])[1]].append(x[p])
            for j, xs in groups.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    coded = [[near(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in c) for c in coded]
    by = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        by[r[2]] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{j:02x}" for _, j in c), e, by[r[2]], sha) for r, c, e in zip(rows, coded, errors, strict=True)), key=repr)


def test_vector_codes(spark):
    rows = odd_rows()
    found = vector_codes.compress(frame(spark, rows), frequent=4)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == quantised(usable(rows, 4096))


def test_vector_codes_of_few_or_no_rows(spark):
    few = odd_rows()[:3]
    assert sorted((tuple(r) for r in vector_codes.compress(frame(spark, few)).collect()), key=repr) == quantised(usable(few, 4096))
    assert vector_codes.compress(frame(spark, [])).collect() == [] == vector_codes.compress(frame(spark, [(1, None, 1, *EXTRA), (None, [], None, *EXTRA)])).collect()
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(frame(spark, [(1, [1.0] * 12, 1, *EXTRA)]))


@pytest.mark.parametrize("size", [3, 2000, 1 << 27])
def test_nearest_is_exact(size):
    """Ties, equal entries and integers that float32 can't hold."""
    r = np.random.default_rng(size)
    book = r.integers(-size, size, (16, 8))
    book[5], book[9] = book[2], -book[2]
    x = np.concatenate([r.integers(-size, size, (3000, 8)), book, np.zeros((3, 8), np.int64), (book[:8] + book[8:]) // 2])
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(book))[1] for v in x]
    assert vector_codes.nearest(x, book).tolist() == want


def test_decode_is_near(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = vector_codes.train(df)
    for r in vector_codes.encode(df, books).limit(20).join(df, F.col("key") == F.col("vec_id")).collect():
        gap = float(((np.array(r.embedding) - vector_codes.decode(r.code, books)) ** 2).sum()) * 4096**2
        assert gap == pytest.approx(r.error, rel=0.05, abs=2000)


def test_whitening(spark):
    rows = odd_rows()
    kept = usable(rows, 256)
    points = np.array(sorted({tuple(x) for _, x, _ in kept}))
    n, sums = len(points), points.sum(0)
    values, axes = np.linalg.eigh(np.cov(points.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1].T
    found = whitening.whiten(frame(spark, rows)).collect()
    assert len(found) == 4 * len(kept) and {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9
    sign = {}
    by = defaultdict(list)
    for r in found:
        by[r.vec_id, r.component].append(r)
    for k, x, _ in kept:
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(4):
            want = float((np.array(x) - sums / n) @ axes[c] / np.sqrt(values[c]))
            match = [r for r in by[k, c + 1] if r.deviation == deviation and abs(abs(r.whitened) - abs(want)) < 1e-8]
            assert match and match[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            if abs(want) > 1e-6:
                assert sign.setdefault(c, match[0].whitened * want > 0) == (match[0].whitened * want > 0)


def test_whitening_without_variance(spark):
    one = [(i, [0.5] * 8, 0, *EXTRA) for i in range(3)]
    assert whitening.whiten(frame(spark, one)).collect() == [] == whitening.whiten(frame(spark, [])).collect()
    line = [(i, [0.5 * i] + [1.0] * 7, 0, *EXTRA) for i in range(5)]
    found = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in found} == {1} and len(found) == 5 and found[0].explained == pytest.approx(1)


def test_whitening_merges_factors_of_many_partitions(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    points = common.materialise(whitening.fit_list(df, "embedding", 256, 6).repartition(30), "points")
    of = whitening.fit(points.repartition(30), 6)
    whole = np.floor(x * 256)
    assert np.allclose(of.eigenvalues, np.linalg.eigvalsh(np.cov(whole.T, bias=True))[::-1][:4], rtol=1e-10)


def test_deviations_beyond_longs():
    x = np.array([[1 << 40, -(1 << 40), 3], [5, 6, 7]])
    of = whitening.Whitening(10**7, [12345678901234567, -3, 1], np.zeros((0, 3)), np.zeros(0), np.zeros(0), 256)
    assert of.deviations(x) == [sum((10**7 * int(a) - s) ** 2 for a, s in zip(v, of.sums, strict=True)) for v in x]
    wide = np.array([[1, -1, 2], [1 << 20, 0, -5], [1 << 50, 3, -(1 << 61)]])
    assert whitening._unpacked(whitening._packed(wide), 3).tolist() == wide.tolist()


def encoded(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary(token_files.VOCABULARY))
    return [[*model.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_encoder_gives_the_tokenizers_ids():
    r = random.Random(1)
    alphabet = [" ", "\n", "\t", "  ", "a", "é", " ", "　", " ", "'s", "1", ".", "\u0085", "<|endoftext|>", "中", "\x1c", "\x7f", "W", "×", "À", "’"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(4000)] + ["x" * 5000, " " * 3000, None, "the end.\n\nThe don't"]
    data, off = token_files.words.texts(token_files.pa.array(texts))
    encoder = token_files.Encoder(packing.vocabulary(token_files.VOCABULARY))
    for part in range(2):  # the second time all pieces are known
        ids, at = encoder.encode(data, off, 0)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == encoded(texts), part


def test_grammar_round_trip():
    r = np.random.default_rng(3)
    phrase = r.integers(0, 50, 40)
    for ids in (np.tile(phrase, 200), np.zeros(5000, int), r.integers(0, 3, 4000), r.integers(0, 50000, 300), np.array([7]), np.zeros(0, int)):
        ids = ids.astype(np.uint32)
        last = r.random(len(ids)) < 0.01
        last[-1:] = True
        g = token_files.compress(ids, last, frequent=4)
        counts = np.diff(np.flatnonzero(last), prepend=-1)
        shard = token_files.Shard(token_files.to_bytes([None, *range(1, len(counts))][: len(counts)], counts, g))
        shard.check()
        assert (shard.all_ids() == ids).all() and g.last.sum() == last.sum() and len(g.symbols) <= len(ids)
        ends = np.cumsum(counts)
        for doc in range(len(counts)):
            whole = ids[ends[doc] - counts[doc] : ends[doc]].tolist()
            for lo, hi in ((0, 1), (0, counts[doc]), (counts[doc] // 2, counts[doc] // 2 + 9), (3, 2), (counts[doc], counts[doc] + 5)):
                assert shard.window(doc, lo, hi).tolist() == whole[lo:hi]
    assert len(token_files.compress(np.tile(phrase, 200).astype(np.uint32), np.zeros(8000, bool), 4).symbols) < 20


def test_damaged_shard_is_told():
    data = bytearray(token_files.to_bytes([1], np.array([5]), token_files.compress(np.arange(5).astype(np.uint32), np.array([0, 0, 0, 0, 1], bool))))
    data[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.Shard(data).check()


def placed(docs):
    """(key, start, n, crc) in the order of keys, null keys last."""
    out, at = [], 0
    for (k, _), ids in zip(docs, encoded([t for _, t in docs]), strict=True):
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(odd, nulls, none, spark):
    for df in (odd, nulls):
        found = [tuple(r) for r in token_files.read(token_files.write(df, shard_ids=4000, file_bytes=20000)).collect()]
        docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted((k, n, c) for k, _, n, c in found if k is not None) == sorted((k, n, c) for k, _, n, c in placed(docs) if k is not None)
        at, seen = 0, []
        for k, start, n, _ in sorted(found, key=lambda r: r[1]):
            assert start == at
            at += n
            seen.append((k is None, k or 0))
        assert seen == sorted(seen) and len(seen) == len(docs)
    assert token_files.read(token_files.write(none)).collect() == []


def test_op13(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in token_files.op13_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == placed(docs)


def test_windows_of_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    manifest = token_files.write(df, shard_ids=20000)
    assert manifest.count() > 3
    r = manifest.first()
    shard_docs = [k for k in df.select("doc_id").orderBy("doc_id").limit(r.docs).toPandas().doc_id] if (r.part, r.shard) == (0, 0) else []
    texts = dict(df.select("doc_id", "text").collect())
    whole = dict(zip(texts, encoded(texts.values()), strict=True))
    wanted = manifest.crossJoin(df.select(F.col("doc_id").alias("key"), F.lit(2).cast("long").alias("lo"), F.lit(7).cast("long").alias("hi")))
    found = token_files.window(manifest, wanted).collect()
    assert sorted(r.key for r in found) == sorted(texts) and all(r.ids == whole[r.key][2:7] for r in found) and shard_docs is not None


def test_unusable_vectors():
    import pyarrow as pa

    column = pa.array([None, [1.0, 2.0], [1.0], [float("nan"), 1.0], [0.5, None], [-0.1, 1e300]], pa.list_(pa.float64()))
    rows, x = vectors.integers(column.slice(1), 10, 2, 1 << 40)
    assert rows.tolist() == [0] and x.tolist() == [[10, 20]]
