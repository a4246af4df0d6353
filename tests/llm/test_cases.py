"""Every operator on odd rows, null rows and no rows, held against brute force."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import common, exact_dedup, language_id, licenses, line_dedup, media, mixing, ngram_join, packing, sharding, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def got(df):
    return [r.asDict() for r in df.collect()]


def docs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_dedup(odd, nulls, none):
    for df in (odd, nulls):
        docs, groups = docs_of(df), defaultdict(list)
        for k, t in docs:
            groups[(t or "").translate(LOW)].append(k)
        want = Counter()
        for k, t in docs:
            n = (t or "").translate(LOW)
            ids = [x for x in groups[n] if x is not None]
            keep = max(ids) if ids else None
            want[k, keep, len(groups[n]), k == keep, hashlib.sha256(n.encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got(exact_dedup.exact_dedup(df))) == want
    assert got(exact_dedup.exact_dedup(none)) == []


def test_exact_dedup_heavy_hitters(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(3000)]
    found = got(exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), frequent=8, counters=16))
    sizes = Counter(t for _, t in rows)
    assert len(found) == 3000 and all(r["group_size"] == sizes[dict(rows)[r["doc_id"]]] for r in found)
    assert sum(r["kept"] for r in found) == len(sizes)


def shards(df, **law):
    rows = df.withColumns({"w": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "c": F.coalesce(F.length("text"), F.lit(0)), "h": F.xxhash64(F.coalesce("text", F.lit("")))})
    return sharding.kd_shards(rows, ["w", "c"], "w", "h", **law)


def test_sharding(odd, nulls, none, spark):
    found = got(shards(odd, leaves=4))
    assert len(found) == odd.count() and all(0 <= r["shard"] < 4 for r in found)
    by = defaultdict(set)
    for r in found:
        by[r["text"] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    assert len(got(shards(nulls, leaves=4))) == 3 and got(shards(none, leaves=4)) == []
    many = spark.range(20000).selectExpr("id as doc_id", "repeat('x', cast(pmod(hash(id), 500) as int)) || id as text")
    sizes = Counter()
    for r in got(shards(many, leaves=8)):
        sizes[r["shard"]] += r["w"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * min(sizes.values())
    limit = sum(sizes.values()) // 11
    leaves = Counter()
    for r in got(shards(many, target_bytes=limit)):
        leaves[r["shard"]] += r["w"]
    assert max(leaves.values()) <= limit and len(leaves) == 16


def test_numbered_is_gapless(spark):
    df = common.materialise(spark.range(5000).selectExpr("id", "if(id % 3 = 0, 0, id % 5) as g"), "g")
    by = defaultdict(list)
    for r in got(common.numbered(df, ["g"], "id", "slot")):
        by[r["g"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_media(odd, nulls, none, spark):
    for df in (odd, nulls):
        want = Counter()
        for k, t in docs_of(df):
            b = (t or "").encode()
            want[str(k), b + b"\xff" * (-len(b) % 576 or (0 if b else 576))] += 1
        found = got(media.read_archives(spark, media.write_archives(df, archive_bytes=20000), split_bytes="5000"))
        assert Counter((r["member"].removesuffix(".png").replace("null", "None"), bytes(r["samples"])) for r in found) == want
        assert all(r["error"] is None and media.from_png(bytes(r["media"])) == bytes(r["samples"]) for r in found)
    assert got(media.read_archives(spark, media.write_archives(none))) == []


def test_media_retries_a_member_alone(spark, tmp_path):
    where = tmp_path / "archives"
    where.mkdir()
    import zipfile

    with zipfile.ZipFile(where / "a.zip", "w") as z:
        for i in range(5):
            z.writestr(f"{i}.png", media.to_png(bytes([i]) * 576))
    data = bytearray((where / "a.zip").read_bytes())
    with zipfile.ZipFile(where / "a.zip") as z:
        at = z.infolist()[2].header_offset
    data[at + 60] ^= 255
    (where / "a.zip").write_bytes(bytes(data))
    (where / "b.zip").write_bytes(b"no directory")
    spark.dataSource.register(media.MediaArchives)
    found = {r["member"]: r for r in got(spark.read.format("media_archives").options(path=f"file://{where}", retries="2").load())}
    assert len(found) == 6 and found["2.png"]["attempts"] == 3 and found["2.png"]["error"]
    assert found[None]["archive"].endswith("b.zip") and found[None]["attempts"] == 3 and found[None]["error"] and found[None]["samples"] is None
    assert all(found[f"{i}.png"]["error"] is None and bytes(found[f"{i}.png"]["samples"]) == bytes([i]) * 576 for i in (0, 1, 3, 4))


def test_packing(odd, nulls, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary())
    for df in (odd, nulls):
        want = Counter()
        for k, t in docs_of(df):
            ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
            for i in range(0, len(ids), 2048):
                p = np.array(ids[i : i + 2048], "<u4")
                want[k, i // 2048, i, len(p), zlib.crc32(p.tobytes())] += 1
        found = got(packing.pack_documents(df))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
        by = defaultdict(list)
        for r in found:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in by.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end += n
            assert end <= 2048
        assert len(by) <= -(-sum(r["length"] for r in found) // 2048) + 1
    assert got(packing.pack_documents(none)) == []


def best_fit(sizes, capacity):
    """The number of sequences of sequential best fit decreasing."""
    gaps: list[int] = []
    for n in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    return len(gaps)


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_in_rounds_is_close_to_sequential_best_fit(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(1, 50), r.randint(1, 12), 17, 50]) for _ in range(700)]
    rows = [(r.choice([i, 7, None]), 0, 0, n, 1) for i, n in enumerate(sizes)]
    found = got(packing.pack(common.materialise(spark.createDataFrame(rows, packing._PIECE).repartition(6), "p"), 50, (1, 2, 3, 5, 9)))
    assert Counter((x["key"], x["length"]) for x in found) == Counter((x[0], x[3]) for x in rows)
    by = defaultdict(list)
    for x in found:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 50
    assert len(by) <= 1.01 * best_fit(sizes, 50) + 1


def test_sweep_takes_the_smallest_slot_that_is_free(spark):
    """Across partitions too: the same pairs as one stack over all."""
    r = random.Random(4)
    sizes, slots = [r.randint(1, 300) for _ in range(400)], [r.randint(1, 300) for _ in range(300)]
    items = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing._PIECE)
    gaps = spark.createDataFrame([(i, 0, 0, n) for i, n in enumerate(slots)], "seq long, at long, used long, size long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = got(packing.sweep(items, gaps))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stack, want = [], {}
    for n, kind, i in sorted([(-n, 0, i) for i, n in enumerate(slots)] + [(-n, 1, i) for i, n in enumerate(sizes)]):
        if kind == 0:
            stack.append(i)
        else:
            want[i] = stack.pop() if stack else None
    assert {x["key"]: x["seq"] for x in found} == want and len(found) == len(sizes)


def shingled(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    sets = [(k, shingled(t)) for k, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (ka, a) in enumerate(sets):
        for j, (kb, b) in enumerate(sets[:i]):
            if ka is not None and kb is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i)) if k is not None else None) for i, (k, s) in enumerate(sets)]


def test_ngram_join(odd, nulls, none):
    for df in (odd, nulls):
        found = got(ngram_join.ngram_join(df))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == Counter(x for x in components(docs_of(df)) if x[0] is not None)
        assert len(found) == df.count()
    assert got(ngram_join.ngram_join(none)) == []


@pytest.mark.parametrize(("big", "families"), [(4096, 60), (10, 20)])
def test_ngram_join_near_the_threshold(spark, monkeypatch, big, families):
    """Families of texts that differ by about as much as the threshold allows, of all sizes,
    and a passage that dissimilar texts share."""
    import random

    monkeypatch.setattr(ngram_join, "BIG", big)
    monkeypatch.setattr(ngram_join, "LEVELS", 1)
    r, rows = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    for family in range(families):
        n = r.choice([5, 6, 7, 8, 9, 12, 14, 20, 25, 33, 50, 80, 150, 300])
        base = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 40))):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 2)] = [r.choice(vocabulary)] * r.randint(0, 2)
            rows.append((len(rows), " ".join(w)))
    for _ in range(2 * families + 30):
        rows.append((len(rows), " ".join([r.choice(vocabulary) for _ in range(r.randint(20, 40))] + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got(ngram_join.ngram_join(df))) == Counter(components(rows))


def test_signatures_meet():
    """Linked sets share a signature, whatever their sizes and however they differ."""
    r = np.random.default_rng(3)
    for n in [5, 6, 8, 9, 10, 13, 19, 28, 42, 63, 100, 141, 400, 1000, 5000]:
        for _ in range(40 if n < 500 else 6):
            x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            d = (2 * len(x)) // 9
            gone = r.integers(0, d + 1)
            y = np.delete(x, r.choice(len(x), gone, replace=False))
            more = max(0, (len(x) + len(y)) // 9 - gone)
            y = np.unique(np.append(y, r.integers(0, 2**63, r.integers(0, more + 1), dtype=np.uint64)))
            both = len(np.intersect1d(x, y))
            if ngram_join.linked(len(x), len(y), both) and both < max(len(x), len(y)):
                assert len(np.intersect1d(ngram_join.signatures(x), ngram_join.signatures(y)))


def version(t):
    """The hash that tells texts of one key apart."""
    return np.int64(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42))) if t is not None else np.int64(42)


def windows_removed(docs, width=3):
    """(lines that count, places of removed ones) of each named (key, text)."""
    first, places, out = {}, {}, {}
    for k, t in sorted({(k, t) for k, t in docs if k is not None}, key=lambda x: (x[0], version(x[1]))):
        lines = [(i, x) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        places[k, t] = lines
        for p in range(len(lines) - width + 1):
            first.setdefault(tuple(x for _, x in lines[p : p + width]), (k, t, p))
    for (k, t), lines in places.items():
        gone = set()
        for p in range(len(lines) - width + 1):
            if first[tuple(x for _, x in lines[p : p + width])] != (k, t, p):
                gone.update(i for i, _ in lines[p : p + width])
        out[k, t] = (len(lines), gone)
    return out


def untouched(df, found, changed):
    """All columns but those in changed are as they were, row by row."""
    names = [c for c in df.columns if c not in changed]
    assert set(df.columns) <= set(found[0]) if found else True
    assert Counter(tuple(r[c] for c in names) for r in found) == Counter(tuple(r[c] for c in names) for r in got(df))


def test_line_dedup(odd, nulls, none):
    for df in (odd, nulls):
        docs = docs_of(df)
        gone, want = windows_removed(docs), Counter()
        for k, t in docs:
            n, places = gone[k, t] if k is not None else (sum(1 for x in (t or "").split("\n") if WORD.search(x)), ())
            left = None if t is None else "" if places and len(places) == n else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in places)
            want[k, n, len(places), left] += 1
        found = got(line_dedup.line_dedup(df))
        assert Counter((r["doc_id"], int(r["n_lines"]), r["n_removed"], r["text"]) for r in found) == want
        untouched(df, found, {"text", "n_lines"})
    assert got(line_dedup.line_dedup(none)) == []


def test_line_dedup_with_an_unnamed_row(spark):
    text = "one\ntwo\nthree\nfour"
    df = spark.createDataFrame([(None, text), (7, text), (9, "own\n" + text), (None, text)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"], r["text"]) for r in got(line_dedup.line_dedup(df)))
    assert found == [(0, 4, 0, text), (0, 4, 0, text), (7, 4, 0, text), (9, 5, 4, "own")]


def test_language_id(odd, nulls, none):
    model = language_id.train(odd.filter(~language_id.held_out()))
    found = {(r["doc_id"], r["text"]): r for r in got(language_id.identify(odd, model))}
    for (_, t), r in found.items():
        letter = any(c.isalpha() for c in t or "")
        assert (r["lang_pred"] == "und") == (not letter) and 0 <= r["score"] <= 1
    right = [r["lang_pred"] == r["lang"] for (k, _), r in found.items() if k >= 100]
    assert sum(right) >= 0.95 * len(right)
    assert {r["lang_pred"] for r in got(language_id.identify(nulls, model))} <= {"und", "en", "fr", "de"}
    assert got(language_id.identify(none, language_id.train(none))) == []
    assert {r["lang_pred"] for r in got(language_id.identify(odd, language_id.train(none)))} == {"und"}


@pytest.mark.parametrize("block", [512, 64, 7, 3])
def test_cross_parsing_is_longest_match(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    texts = {"en": "abracadabra brad", "fr": "cabbage bandana cabana"}
    model = language_id.Model(texts, 1000)
    for probe in ["abracabana", "zzz", "a", "bandbrad cab", "abra " * 300]:
        counts = {}
        s = language_id.symbols([probe], model.symbol)[0].tolist()
        for i, lang in enumerate(model.langs):
            ref = bytes(language_id.symbols([texts[lang]], model.symbol)[0].tolist())
            n = at = 0
            whole = bytes(s)
            while at < len(whole):
                m = 1
                while at + m < len(whole) and whole[at : at + m + 1] in ref:
                    m += 1
                at, n = at + m, n + 1
            assert model.phrases([probe])[i][0] == n
            assert model.phrases(["x", probe, "", probe])[i].tolist()[1::2] == [n, n]
            counts[lang] = n * np.log2(len(ref))
        (least, found), (second, _) = sorted((c, x) for x, c in counts.items())
        assert model.predict([probe])[0] == [found] and model.predict([probe])[1][0] == pytest.approx(second / (second + least))


def test_languages_past_the_table_are_told_apart():
    r = random.Random(3)
    letters = {"mixed": [chr(c) for a, b in ((0x61, 0x7B), (0x3B1, 0x3C2), (0x430, 0x450)) for c in range(a, b)], "zh": [chr(0x4E00 + 7 * i) for i in range(300)], "ko": [chr(0xAC00 + 7 * i) for i in range(300)]}
    text = lambda k, n: " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(1, 4))) for _ in range(n))
    texts = {"mixed": text("mixed", 9000), "zh": text("zh", 1500), "ko": text("ko", 1500)}
    model = language_id.Model(texts, 24_000)
    probes = [(k, texts[k][50:150] if i % 2 else text(k, 40)) for i in range(8) for k in letters]
    langs, scores = model.predict([p for _, p in probes])
    assert langs == [k for k, _ in probes] and all(scores > 0.5)
    learned = {k: "".join(map(chr, language_id.symbols([t], model.symbol)[0][:24_000].tolist())) for k, t in texts.items()}
    for probe in (texts["ko"][9:70] + "\u4e00x\u10d0 " + texts["zh"][3:60], "\u10d0\u10d1 \u10d2"):
        s = "".join(map(chr, language_id.symbols([probe], model.symbol)[0].tolist()))
        for i, lang in enumerate(model.langs):
            at = n = 0
            while at < len(s):
                m = 1
                while at + m < len(s) and s[at : at + m + 1] in learned[lang]:
                    m += 1
                at, n = at + m, n + 1
            assert model.phrases([probe])[i][0] == n


def substring_brute(docs, width):
    """(words, removed ones, what is left) of each named row."""
    first, out = {}, {}
    for k, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            if k is not None:
                g = tuple(w[i : i + width])
                first[g] = min(k, first.get(g, k))
    for k, t in docs:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - width + 1):
            if k is not None and first[tuple(w[i : i + width])] < k:
                gone.update(range(i, i + width))
        out[k, t] = (len(w), len(gone), None if t is None else " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("width", "anchor", "frequent"), [(50, 32, 512), (12, 5, 512), (12, 5, 10**9)])
def test_substring_dedup(odd, nulls, none, monkeypatch, width, anchor, frequent):
    monkeypatch.setattr(substring_dedup, "FREQUENT", frequent)
    for df in (odd, nulls):
        docs = docs_of(df)
        want = substring_brute(docs, width)
        found = got(substring_dedup.substring_dedup(df, width=width, anchor=anchor, bits=16))
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found) == Counter((k, *want[k, t]) for k, t in docs)
        untouched(df, found, {"text", "n_words"})
    assert got(substring_dedup.substring_dedup(none)) == []


def test_mixing(odd, nulls, none, spark, monkeypatch):
    for df in (odd, nulls):
        rows = got(mixing.mix(df))
        assert len(rows) == df.count()
        for r in rows:
            assert len(r["draws"]) <= 2 and (r["size"] or not r["draws"]) and all(d["shard"] is not None for d in r["draws"])
    assert got(mixing.mix(none)) == []
    many = spark.range(30000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', if(id % 50 = 1, null, concat('s', id % 7))) as source", "trim(repeat('w ', cast(1 + pmod(hash(id), 60) as int))) as text").repartition(5)
    first, again = (sorted((r["doc_id"], json.dumps([list(d) for d in r["draws"]])) for r in got(mixing.mix(many, block_rows=64))) for _ in range(2))
    assert first == again
    monkeypatch.setattr(mixing, "FEW", 0)  # as with very many sources: no broadcasts
    assert first == sorted((r["doc_id"], json.dumps([list(d) for d in r["draws"]])) for r in got(mixing.mix(many, block_rows=64)))
    found = mixing.mix(many, block_rows=64).join(many.select("doc_id", "source"), "doc_id").collect()
    size, taken, target, shard = Counter(), Counter(), {}, Counter()
    for r in found:
        size[r.source] += r["size"]
        taken[r.source] += r["size"] * len(r.draws)
        target[r.source] = r.target
        for d in r.draws:
            shard[d["shard"]] += 1
    assert all(abs(taken[s] - target[s]) <= 60 for s in size) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1
    assert all(target[s] <= 2 * size[s] + 1e-6 for s in size) and set(shard) == set(range(8)) and max(shard.values()) < 1.25 * min(shard.values())


def test_mixing_keeps_wordless_sources_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BITS", 3)
    many = spark.range(6000).selectExpr("id as doc_id", "case when id % 10 = 1 then 'bare' when id % 10 = 2 then 'few' else 'hot' end as source", "if(id % 10 = 1, array(null, '', ' ')[int(id div 10 % 3)], trim(repeat('w ', cast(1 + id % 7 as int)))) as text")
    found = mixing.mix(many, block_rows=16).join(many.select("doc_id", "source"), "doc_id").collect()
    assert len(found) == 6000 and len({r.doc_id for r in found}) == 6000
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r["size"] * len(r.draws)
        target[r.source] = r.target
    assert taken["bare"] == target["bare"] == 0 and all(abs(taken[s] - target[s]) <= 7 for s in target)


def test_targets_are_water_filled(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 400, "e": 0, None: 50}
    names = sorted([k for k in sizes if k is not None]) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    whole, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = whole - sum(2 * sizes[k] for k in full)
        share = {k: 2 * sizes[k] if k in full else rest * weight[k] / sum(weight[x] for x in sizes if x not in full) for k in sizes}
        over = {k for k in sizes if k not in full and share[k] > 2 * sizes[k]}
        if not over:
            break
        full |= over
    found = mixing.targets(spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, words long, n long"))
    assert {r["source"]: pytest.approx(r["target"]) for r in got(found)} == share


def test_license_scan(odd, nulls, none, spark):
    texts = {
        1: "intro\nReleased under the MIT License.\nmore", 2: "Licensed under CC BY-NC 4.0.", 3: "Licensed under the Apache License, Version 1.1.", 4: "a license to thrill",
        5: "This work is licensed under the GNU General Public License, version 3.", 6: "Copyright 2020 Ada Vale. All rights reserved.", 7: None, 8: "x\n" * 5000 + "Licensed under the Apache License, Version 2.0.",
        9: "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    }
    found = {r["doc_id"]: r for r in got(licenses.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))}
    exact = {k: [x["license"] for x in r["licenses"] if x["exact"]] for k, r in found.items()}
    assert exact == {1: ["MIT"], 2: ["CC-BY-NC-4.0"], 3: [], 4: [], 5: ["GPL-3.0-only"], 6: ["Proprietary"], 7: [], 8: ["Apache-2.0"], 9: ["MIT"]}
    assert found[3]["licenses"][0]["differences"] == ["2.0>1.1"] and found[8]["licenses"][0]["line"] == 5000
    assert len(got(licenses.license_scan(odd))) == odd.count() and len(got(licenses.license_scan(nulls))) == 3 and got(licenses.license_scan(none)) == []


def test_license_scan_inside_lines():
    scan, before, after = licenses.Scanner().scan, "the river ran past seven old mills " * 8, "and nobody there could tell who built them " * 8
    for name, templates in licenses.all_templates().items():
        for text in templates:
            found = scan(f"{before}. {text.replace('<...>', '2020 Ada Vale.')} {after}.")[1]
            assert [(x["license"], x["line"]) for x in found if x["exact"]] == [(name, 0)]
    assert [(x["license"], x["differences"]) for x in scan(f"{before}. Licensed under the Apache License, Version 1.1. {after}")[1]] == [("Apache-2.0", ["2.0>1.1"])]
    for more, diff in (("v3.0 or later", "+or later"), ("v3.0+", "++")):
        assert [(x["exact"], x["differences"]) for x in scan(f"{before}. Licensed under the GNU General Public License {more}. {after}")[1]] == [(False, [diff])]
    both = scan(f"{before} Released under the MIT License. {after} Licensed under CC0 1.0. {after}")[1]
    assert [x["license"] for x in both] == ["MIT", "CC0-1.0"]


def test_license_scan_agrees_with_all_templates_tried_on_all_blocks():
    """A word of a notice changed: the licence told is one whose wording differs least, by brute
    force over every block of every template's length."""
    scanner, r = licenses.Scanner(), random.Random(2)
    sizes = [len(licenses.words_of(t)) for _, t in scanner.rows]
    for row, (_, text) in enumerate(scanner.rows):
        words = text.replace("<...>", "ada").split()
        if sizes[row] < 9:
            continue
        k = r.randrange(3, len(words) - 3)
        line = " ".join(["the river ran past seven old mills and nobody there could tell", *words[:k], "quorble", *words[k + 1 :], "who had built them when the town was young"])
        found = [x for x in scanner.scan(line)[1] if not x["exact"]]
        if not licenses._TRIGGER.search(line) or any(x["exact"] for x in scanner.scan(line)[1]):
            continue
        own = licenses.words_of(line)
        best = {}
        for (name, t), n in zip(scanner.rows, sizes, strict=True):
            for i in range(0, max(1, len(own) - n)):
                diff = licenses.differences(own[max(0, i - 1) : i + n + 1], t)[0]
                best[name] = min(best.get(name, 10**9), sum(len(x.split()) for x in diff) / n)
        assert found and best[found[0]["license"]] <= min(best.values()) + 0.35, (line, found, best)


def test_license_scan_of_wrapped_notices(spark):
    texts = {
        1: ("MPL-2.0", 2, "intro\n\nThis Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at the address."),
        2: ("BSD-3-Clause", 0, "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage main"),
        3: ("MIT", 1, "# by Ada\n# Permission is\n# hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation\n# files (the \"Software\"), to deal in the Software without restriction\nmore"),
        4: ("Apache-2.0", 12, "x\n" * 12 + "Licensed under the Apache\nLicense, Version 2.0.\n" + "x\n" * 40),
        5: ("Proprietary", 1, "first\nAll rights\nreserved."),
    }
    found = got(licenses.license_scan(spark.createDataFrame([(k, t) for k, (_, _, t) in texts.items()], "doc_id long, text string")))
    assert {r["doc_id"]: [(x["license"], x["line"]) for x in r["licenses"] if x["exact"]] for r in found} == {k: [(n, i)] for k, (n, i, _) in texts.items()}


def test_pipeline(odd, nulls, none, spark, tmp_path):
    for i, df in enumerate((odd, nulls, none)):
        df.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        found = got(corpus_pipeline.run(spark, f"{tmp_path}/{i}"))
        assert (found == []) == (i == 2)
    docs, names = spark.read.parquet(f"{tmp_path}/0/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        names.append(name)
        out = common.materialise(stage(spark, docs, f"{tmp_path}/0"), name)
        assert out.columns == docs.columns
        docs = out
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "mix_sources"]


def test_license_findings_come_out_of_the_ranking():
    """All wording is looked for only in what compression ranked; names of running text are told as such."""
    scanner = licenses.Scanner()
    names = {"Licensed under Apache 2.0": "Apache-2.0", "This package uses the MIT licence": "MIT", "released under the zlib licence": "Zlib", "Licenced under the Unlicense": "Unlicense", "subject to the Eclipse Public License 2.0": "EPL-2.0"}
    for line, name in names.items():
        found = scanner.scan(f"Some words before, {line}, and some after it.")[1]
        assert [(x["license"], x["exact"], x["differences"]) for x in found] == [(name, False, ["name only"])]
    before, n = scanner.places, 0
    for t in (t for ts in licenses.all_templates().values() for t in ts):
        blocks, found = scanner.scan(t)
        n += blocks
        assert found and all(x["rank"] >= 1 and x["saved"] > 0 for x in found)
    assert scanner.places - before == n
    whole = scanner.ranked
    scanner.ranked = lambda *a: []
    assert scanner.scan("Released under the MIT License.")[1] == [] and whole
