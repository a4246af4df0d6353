"""N-gram Jaccard join by PartEnum signatures.

Two sets of 5-word shingles link when their Jaccard similarity is at least 0.8, which
for sizes r and s means that at most (r + s) / 9 shingles are in one of them only.

Signatures. Sets are compared in bands of sizes; K = 2 * high / 9 bounds the difference
of two linked sets of a band (a set whose partner may be in the next band signs for
both). The feature domain, 64-bit hashes, is partitioned into n1 groups of two parts.
With n1 = K // 2 + 1 + t groups, at least 1 + t of them differ by one shingle at most,
and in such a group one of the two subsets of one part is equal: a signature that both
sets have.

Empty parts would make sets meet that share nothing, so an empty subset is no
signature. Where one part of a group is empty, the other one also signs without each of
its shingles. A group of fewer than two shingles might still hide a link; if a set has
more than t such groups it also signs with another partition, and so on, so a linked
pair always shares a signature: of the 1 + t groups that nearly agree one has two
shingles or more in whichever set has no more than t sparse groups.

Sets that are equal are one node from the start. Signatures are shuffled and sorted,
and buckets with one node vanish. Then, each step being exact:

1. star: each node of a bucket against the bucket's least node;
2. near: in buckets whose nodes aren't all connected yet, pairs whose parity sketches
   (a lower bound of the difference) allow a link: all of them in buckets of SMALL
   nodes at most, enough to connect what may be connected in larger ones;
3. rest: in larger buckets, all other such pairs between nodes that still aren't
   connected.

A passage that very many texts share may still fill a bucket with nodes that don't link.
One with more than BIG labels is split: linked sets also share a signature of another
partition, so its nodes meet only where they share both.

Every pair is verified on the whole sets. Components come from label propagation with
pointer jumping, written to the shared folder each round.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

U = np.uint64
N = 5
_SEEDS = 256
SMALL = 16
#: Buckets of more labels than BIG are split by signatures of up to LEVELS further partitions.
BIG, LEVELS = 4096, 3
_HALF = U(0xA0761D6478BD642F)


def bands(most: int = 1 << 40) -> list[int]:
    """The least size of each band; the ratio of two is 1.5 from small sizes on."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


BANDS = np.array(bands())


def sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text: its place in the column and its sorted distinct shingles."""
    for w in words.each(column, lower=True):
        s = words.shingles(w, N)
        for i in range(w.hi - w.lo):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= N:
                x = np.sort(s[a : b - N + 1])
                new = np.ones(len(x), bool)
                new[1:] = x[1:] != x[:-1]
                yield w.lo + i, x[new]
            elif b > a:  # the whole sequence as one shingle
                x = words.mix(w.hashes[a:b] + np.arange(1, b - a + 1).astype(U) * _HALF)
                yield w.lo + i, words.mix(x.sum(keepdims=True) + U(int(b - a)))
            else:
                yield w.lo + i, np.zeros(0, U)


def name(x: np.ndarray) -> int:
    """A set's node: a 64-bit hash, equal for equal sets."""
    h = words.mix(words.mix(x ^ _HALF).sum(keepdims=True) + words.times(len(x), _HALF))
    return int(h.view(np.int64)[0])


@functools.lru_cache(4096)
def _partition(band: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Slack t, the inner edges of the parts and a tag for each; None where linked sets
    of such sizes are equal."""
    k = 2 * (int(BANDS[band + 1]) - 1) // 9
    if k == 0:
        return None
    n1 = k // 2 + 1
    # a set that signs for the next band has 0.8 of its least size: 4.5 shingles a group, of which 0.061
    # of n1 + t groups are sparse, so 0.066 of n1 leaves room at every size
    t = 1 + int(0.066 * n1 + 2 * (0.066 * n1) ** 0.5)
    parts = 2 * (n1 + t)
    edges = (np.arange(1, parts).astype(np.float64) * (2.0**64 / parts)).astype(U)
    return t, edges, words.mix((np.arange(parts).astype(U) << U(24)) + U(band << 8))


def _sign(x: np.ndarray, band: int, seed: int, out: list[np.ndarray]) -> bool:
    """Add the signatures of a set in a band by one partition; whether it has few enough
    sparse groups to need no other."""
    found = _partition(band)
    if found is None:
        return True
    t, edges, tags = found
    y = x
    if seed:
        y, tags = np.sort(words.mix(x + words.times(seed, _HALF))), tags + U(seed)
    cuts = np.zeros(len(tags) + 1, np.int64)
    cuts[1:-1] = np.searchsorted(y, edges)
    cuts[-1] = len(y)
    one = words.mix(y ^ _HALF)
    sums = np.zeros(len(y) + 1, U)
    np.cumsum(one, out=sums[1:])
    c, s = np.diff(cuts), np.diff(sums[cuts])
    full = np.flatnonzero(c)
    out.append(words.mix(s[full] + tags[full]))
    twin = c.reshape(-1, 2)[:, ::-1].ravel()
    alone = np.flatnonzero((twin == 0) & (c > 1))  # parts of two or more beside an empty one
    if len(alone):
        n = c[alone]
        part = np.repeat(alone, n)
        at = np.repeat(cuts[alone] - np.cumsum(n) + n, n) + np.arange(len(part))
        out.append(words.mix(s[part] - one[at] + tags[part]))
    return int((c[::2] + c[1::2] < 2).sum()) <= t


def signatures(x: np.ndarray, level: int = 0) -> np.ndarray:
    """All signatures of a set; each level has partitions of its own."""
    out: list[np.ndarray] = [np.zeros(0, U)]
    first = int(np.searchsorted(BANDS, len(x), "right")) - 1
    band = first
    while band == first or BANDS[band] <= len(x) * 5 // 4:
        for seed in range(level * _SEEDS, (level + 1) * _SEEDS):
            if _sign(x, band, seed, out):
                break
        else:
            raise RuntimeError(f"no partition of {_SEEDS} leaves a set of {len(x)} shingles few enough sparse groups")
        band += 1
    return np.unique(np.concatenate(out)) if len(x) else out[0]


def linked(r: int, s: int, both: int) -> bool:
    return 100 * both >= 80 * (r + s - both)


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def nodes(rows: DataFrame) -> DataFrame:
    """(key, n, node) of each document; node is null where the set is empty."""

    def run(batches):
        for batch in batches:
            n, node = [0] * len(batch), [None] * len(batch)
            for i, x in sets(batch.column(1)):
                if len(x):
                    n[i], node[i] = len(x), name(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["key", "n", "node"])

    return rows.mapInArrow(common.trimmed(run), "key long, n long, node long")


def signed(rows: DataFrame) -> DataFrame:
    """(sig, node): a set's signatures; copies met in one task sign once (the last
    REMEMBERED sets are remembered)."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sigs, of, held = [], [], 0
            for _, x in sets(batch.column(1)):
                node = name(x) if len(x) > 1 else None
                if node is None or node in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(node)
                sigs.append(signatures(x))
                of.append((node, len(sigs[-1])))
                held += len(sigs[-1])
                if held > 1 << 18:
                    yield _signed(sigs, of)
                    sigs, of, held = [], [], 0
            if sigs:
                yield _signed(sigs, of)

    return rows.mapInArrow(common.trimmed(run), "sig long, node long")


def _signed(sigs: list[np.ndarray], of: list[tuple[int, int]]) -> pa.RecordBatch:
    node = np.repeat(np.array([x[0] for x in of], np.int64), [x[1] for x in of])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(node)], ["sig", "node"])


def shared(sigs: DataFrame) -> DataFrame:
    """(sig, node, hub) of buckets with two nodes or more; hub is the bucket's least node.
    A bucket is a run of sorted rows; between batches only its hub and last node are held."""

    def run(batches):
        held: tuple | None = None  # sig, hub, last node, whether the hub's row is out
        for batch in batches:
            if not len(batch):
                continue
            sig, node = (batch.column(i).to_numpy() for i in range(2))
            old = 0
            if held is not None:
                sig, node, old = np.append([held[0]] * 2, sig), np.append(held[1:3], node), 2
            begin = np.ones(len(sig), bool)
            begin[1:] = sig[1:] != sig[:-1]
            at = np.flatnonzero(begin)
            bucket = np.cumsum(begin) - 1
            hub = node[at][bucket]
            other = node != hub
            met = np.maximum.reduceat(other, at)  # whether a bucket has another node
            out = other.copy()
            out[1:] &= begin[1:] | (node[1:] != node[:-1])
            out[:old] = False
            first = at[met]
            if held is not None and held[3]:
                first = first[first > 0]
            keep = np.concatenate([first, np.flatnonzero(out)])
            held = (sig[-1], hub[-1], node[-1], bool(met[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep]), pa.array(hub[keep])], ["sig", "node", "hub"])

    return sigs.sortWithinPartitions("sig", "node").mapInArrow(common.trimmed(run), "sig long, node long, hub long")


def _parity(x: np.ndarray) -> bytes:
    """Bit b: whether an odd number of shingles have b as their low bits. Its size is a
    power of two, so a larger one folds to a smaller one."""
    bits = 1 << max(6, (2 * len(x) - 1).bit_length())
    return np.packbits((np.bincount((x & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def full_sets(rows: DataFrame) -> DataFrame:
    """rows (node, text), the node as it is expected -> (node, n, items, parity); items are
    sorted. A text of another node (its key stands on several rows) is left out; a row may
    come twice, which does no harm below."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out, held, want = [], 0, batch.column(0).to_pylist()
            for i, x in sets(batch.column(1)):
                if len(x) and want[i] not in seen and name(x) == want[i]:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(want[i])
                    out.append((want[i], x))
                    held += len(x)
                if held > 1 << 20:
                    yield _full(out)
                    out, held = [], 0
            if out:
                yield _full(out)

    return rows.select("node", "text").mapInArrow(common.trimmed(run), "node long, n int, items array<long>, parity binary")


def _full(out: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    n = [len(x) for _, x in out]
    items = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate([x for _, x in out]).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array(n, pa.int32()), items, pa.array([_parity(x) for _, x in out], pa.binary())], ["node", "n", "items", "parity"])


def plausible(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and parity sketches allow to link; no sets are moved."""
    a, b = (full.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in "ab")

    def run(batches):
        for batch in batches:
            m = len(batch)
            n = np.concatenate([batch.column(i).to_numpy().astype(np.int64) for i in (2, 4)])
            ok = _may_link(np.arange(m), m + np.arange(m), n, batch.column(3).to_pylist() + batch.column(5).to_pylist()) if m else np.zeros(0, bool)
            yield batch.select([0, 1]).filter(pa.array(ok))

    near = pairs.join(a, "a").join(b, "b").filter("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return near.select("a", "b", "na", "pa", "nb", "pb").mapInArrow(common.trimmed(run), "a long, b long")


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    a, b = (full.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("items").alias(f"i{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("both", F.expr("size(array_intersect(ia, ib))"))
    return both.filter("100 * both >= 80 * (na + nb - both)").select("a", "b")


def _folded(parity: list[bytes], size: int) -> np.ndarray:
    """Sketches of size bytes or more, folded to size, a row each."""
    rows = [np.frombuffer(p, np.uint8) if len(p) == size else np.bitwise_xor.reduce(np.frombuffer(p, np.uint8).reshape(-1, size), 0) for p in parity]
    return np.stack(rows).view("<u8")


def _may_link(i: np.ndarray, j: np.ndarray, n: np.ndarray, parity: list[bytes]) -> np.ndarray:
    """Which pairs of nodes (by place) sizes and sketches allow to link."""
    ok = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
    size = np.array([len(p) for p in parity])
    least = np.minimum(size[i], size[j])
    for b in np.unique(least[ok]):
        at = np.flatnonzero(ok & (least == b))
        some, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        bits = _folded([parity[x] for x in some.tolist()], int(b))
        left, right = back[: len(at)], back[len(at) :]
        for lo in range(0, len(at), 1 << 15):
            k = slice(lo, lo + (1 << 15))
            apart = np.bitwise_count(bits[left[k]] ^ bits[right[k]]).sum(1, dtype=np.int64)
            ok[at[k]] = 9 * apart <= n[i[at[k]]] + n[j[at[k]]]
    return ok


def candidates(rows: DataFrame, everything: bool) -> DataFrame:
    """Pairs (a, b) of a bucket's nodes with different labels that sizes and parity
    sketches allow to link. Buckets of SMALL nodes at most give all of these; larger ones
    all (everything) or enough to connect what may be connected.
    rows: (sig, node, label, n, parity), a partition holding whole buckets, sorted."""

    def large(place, comp, n, parity):
        sketches = [parity[x] for x in place.tolist()]
        bits = _folded(sketches, min(map(len, sketches)))
        for i in range(len(place) - 1):
            j = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
            j = j[5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i])]
            for some in np.array_split(j, len(j) // 65536 + 1):
                apart = np.bitwise_count(bits[some] ^ bits[i]).sum(1, dtype=np.int64)
                for k in some[9 * apart <= n[some] + n[i]].tolist():
                    if everything:
                        yield place[i], place[k]
                    elif comp[k] != comp[i]:
                        comp[comp == comp[k]] = comp[i]
                        yield place[i], place[k]

    def solve(t: pa.Table):
        sig, node = (t[c].to_numpy() for c in ("sig", "node"))
        nodes, first, place = np.unique(node, return_index=True, return_inverse=True)
        label, n = (t[c].to_numpy()[first].astype(np.int64) for c in ("label", "n"))
        parity = t["parity"].take(pa.array(first)).to_pylist()
        begin = np.append(True, sig[1:] != sig[:-1])
        cuts = np.append(np.flatnonzero(begin), len(sig))
        size = np.diff(cuts)
        bucket = np.cumsum(begin) - 1
        tiny = (size <= SMALL)[bucket]
        pairs: list[np.ndarray] = []
        for k in range(1, SMALL):
            i = np.flatnonzero((bucket[k:] == bucket[:-k]) & tiny[k:])
            a, b = place[i], place[i + k]
            differ = label[a] != label[b]
            if len(i) == 0:
                break
            pairs.append(np.unique(a[differ].astype(np.int64) * len(nodes) + b[differ]))
        code = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        i, j = code // len(nodes), code % len(nodes)
        ok = _may_link(i, j, n, parity)
        i, j = i[ok].tolist(), j[ok].tolist()
        for b in np.flatnonzero(size > SMALL).tolist():
            p = place[cuts[b] : cuts[b + 1]]
            for x, y in large(p, label[p], n[p], parity):
                i.append(int(x))
                j.append(int(y))
        return pa.RecordBatch.from_arrays([pa.array(nodes[i] if i else [], pa.int64()), pa.array(nodes[j] if j else [], pa.int64())], ["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            sig = batch.column(0).to_numpy()
            # before the batch's last bucket all that is held is whole
            cut = int(np.searchsorted(sig, sig[-1], "left"))
            last = held[-1].column(0)[len(held[-1]) - 1].as_py() if held else None
            if n + cut >= 1 << 17 and (cut or last != sig[0]):
                whole = [*held, batch.slice(0, cut)]
                held, n = [], 0
                yield solve(pa.Table.from_batches(whole))
                batch = batch.slice(cut)
            held.append(batch)
            n += len(batch)
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(common.trimmed(run), "a long, b long")


def split(buckets: DataFrame, full: DataFrame, level: int) -> DataFrame:
    """buckets (sig, node, label) cut by a signature of another level as well."""

    def run(batches):
        for batch in batches:
            node, items = batch.column(0).to_pylist(), batch.column(1)
            for i, k in enumerate(node):
                sig = signatures(items[i].values.to_numpy().view(U), level)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), k, np.int64)), pa.array(sig.view(np.int64))], ["node", "more"])

    some = full.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "items")
    more = some.mapInArrow(common.trimmed(run), "node long, more long")
    return buckets.join(more, "node").select(F.xxhash64("sig", "more").alias("sig"), "node", "label")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, for all nodes of edges.

    Each round a node takes the least label around it, and then the label of its label;
    rounds are tables in the shared folder. A hub's neighbours are pre-aggregated."""
    both = common.materialise(edges.unionByName(edges.selectExpr("b as a", "a as b")).distinct(), "edges")
    labels = common.materialise(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as label"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(around.withColumnRenamed("a", "node"), "node").selectExpr("node", "label as was", "least(label, m) as label")
        step = common.materialise(step, "step")
        jump = step.selectExpr("node as label", "label as next")
        new = step.join(jump, "label", "left").selectExpr("node", "was", "least(label, coalesce(next, label)) as label")
        new = common.materialise(new, "labels")
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels


def ngram_join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id): one row a document; component_id is the least key
    that is reached by links.

    Words are those of common.WORD, with A-Z lowered. A text of fewer words than a
    shingle is one shingle; null texts and such without words are linked with nothing,
    and so is a row with a null key, whose component_id is null. Keys should differ: rows
    with equal keys are judged one by one. Shingles and sets are told apart by 64-bit
    hashes. Texts of any length give all their shingles. An empty table gives no rows; other
    columns of docs are not looked at.
    """
    rows = _rows(docs, text, key)
    spark = docs.sparkSession
    named = common.materialise(nodes(rows), "nodes")
    classes = common.materialise(named.filter("node is not null and key is not null").groupBy("node").agg(F.min("key").alias("rep")), "classes")
    parts = min(50_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(rows) // (8 << 20)))
    met = common.materialise(shared(signed(rows).repartition(parts, "sig")), "buckets")
    star = met.filter("node <> hub").selectExpr("hub as a", "node as b").distinct()
    some = classes.join(met.select("node").distinct(), "node", "left_semi")
    full = common.materialise(full_sets(rows.join(some.withColumnRenamed("rep", "key"), "key")), "sets")
    tried = common.materialise(star, "star")
    held = [met, full, tried]
    edges = common.materialise(verified(common.materialise(plausible(tried, full), "plausible"), full), "edges")
    labels = components(edges)
    for everything in (False, True):
        now = met.select("sig", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        now = common.materialise(now, "labelled")
        gone = [now]
        parted = []
        for level in range(LEVELS + 1):
            mixed = now.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.approx_count_distinct("label").alias("labels")).filter("lo < hi")
            mixed = common.materialise(mixed.filter(f"size > {SMALL}" if everything else "true"), "mixed")
            big = mixed.filter(f"labels > {BIG}") if level < LEVELS else mixed.limit(0)
            parted.append(now.join(mixed if level == LEVELS else mixed.filter(f"labels <= {BIG}"), "sig", "left_semi"))
            if level == LEVELS or big.isEmpty():
                break
            now = common.materialise(split(now.join(big, "sig", "left_semi"), full, level + 1), "split")
            gone.append(now)
        open_ = functools.reduce(DataFrame.unionByName, parted).join(full.select("node", "n", "parity"), "node").select("sig", "node", "label", "n", "parity")
        pairs = candidates(open_.repartition(parts, "sig").sortWithinPartitions("sig", "node"), everything).distinct()
        pairs = common.materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        common.discard(*gone)
        if pairs.isEmpty():
            continue
        tried = tried.unionByName(pairs)
        held.append(pairs)
        edges = common.materialise(edges.unionByName(verified(pairs, full)), "edges")
        labels = components(edges)
    common.discard(*held)  # labels is a table of its own
    least = labels.join(classes, "node").groupBy("label").agg(F.min("rep").alias("component"))
    at = labels.join(least, "label").select("node", "component")
    found = named.join(classes, "node", "left").join(at, "node", "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "rep", "key")).alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(common.table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLE = {
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS doc_id, least(min(b), a) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
}
