"""Token ids in binary shards, compressed by a Re-Pair grammar each.

Writing. Rows are range-sorted by key, so that each task has a run of the order. It encodes its texts with the
tokenizer, an end id behind each, gathers whole documents up to ``shard_ids`` ids and compresses them: all adjacent
pairs are counted, frequent ones become nonterminals, the new sequence is counted again, until no pair is
frequent. Where chosen pairs overlap the more frequent one is replaced, in a run of one symbol every other one. No pair spans two
documents. Shards are appended to files of bounded size with a name of their own for each attempt; the manifest (a
table in the shared folder, a row a shard) has those of the tasks that Spark counted.

A shard, little-endian: magic, then the numbers of documents, ids, symbols, rules and first nonterminal (5 x uint64); for each
document its key (int64), 1 where it has one (uint8), number of ids (uint64) and of symbols (uint64); the rules' left and right
symbols (2 x uint32 each) and the lengths they expand to (uint64); the symbols, 3 bytes each; CRC-32 of all that (uint32).

Reading. A task reads whole shards, expands the rules level by level and gathers all ids at once. ``window`` reads some ids of one
document: from the shard's head, the document's symbols and the rules' lengths it finds the symbols that cover them
and expands only those.
"""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common, packing, words

VOCABULARY = "byte_bpe_50k.json"
SHARD_IDS = 2 << 20
FILE_BYTES = 128 << 20
MAGIC = b"REPAIR01"
WORDS_KEPT = 1_000_000
SLICE = 4 << 20
_NONE = np.iinfo(np.int32).max
_HEAD = struct.Struct("<8s5Q")
_SYMBOLS, _PLACES = 20, 24  # bits of a symbol and of a place where both fit one key
_PLAIN = re.compile(rb"[ \n][!-~\x80-\xff]*(?:[!-~]|\xc3[\x80-\xbf])")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ENDS = np.zeros(256, bool)  # bytes after which white space surely begins a piece
_ENDS[0x21:0x7F] = True
_ENDS[0x80:] = True
_LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool)  # ASCII letters; ASCII characters that are neither letters nor white space
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER[0x21:0x7F] = True
_OTHER &= ~_LETTER


class Encoder:
    """Ids of whole texts from a byte-level BPE whose pre-tokenizer is the common one of words with a leading space.

    A run of white space after anything else always begins a new pre-token, and what a pre-token is depends on the text that
    follows only. So a text is cut before each run of ASCII white space (but not after other white space, which belongs to
    the run), and where a word's letters end before an ASCII mark or digit, unless the slice has a special token,
    which is found before words are. The ids of the pieces are those of the text. Each distinct piece of a slice (Arrow's dictionary
    encoding finds them) is looked up, or encoded with many others at once, and the ids are gathered in numpy.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith(("Ġ", "Ċ"))]] = True  # space and line feed, as byte-level vocabularies write them
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.at = np.zeros(1 << 12, np.int64)  # of each known piece, its first id in the pool and then their end

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, some: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.known), len(some)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + m + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[n + 1 : n + m + 1] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.known.update(zip(some, range(n, n + m), strict=True))

    def learn(self, new: list[bytes]) -> None:
        plain, other = [], []
        for x in new:
            (plain if _PLAIN.fullmatch(x) else other).append(x)
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = self._ids(b"".join(some).decode())
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(some) and first[0] == 0:  # each piece's first token tells its start
                self._keep(some, ids, np.diff(np.append(first, len(ids))))
            else:
                other += some
        for at in range(0, len(other), 512):
            some = other[at : at + 512]
            rows = [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)]
            self._keep(some, np.concatenate(rows), np.array([len(r) for r in rows]))

    def encode(self, data: np.ndarray, o: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each with end behind, and the first of each."""
        cut = _SPACE[data]
        cut[1:] &= _ENDS[data[:-1]]
        other = np.flatnonzero(cut[3:] & (data[2:-1] >= 0x80)) + 3 if len(data) > 3 else np.zeros(0, np.int64)
        # after a character that may be white space: two bytes from C2, three from E1, E2 or E3
        before2, before3 = data[other - 2], data[other - 3]
        cut[other[(before2 == 0xC2) | ((before2 >= 0x80) & (before3 >= 0xE1) & (before3 <= 0xE3))]] = False
        cut[: min(3, len(cut))] = False
        raw = data.tobytes()
        if not any(t in raw for t in self.special):
            letter = _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            cut[1:] |= letter[:-1] & _OTHER[data[1:]]
        full = o[:-1][np.diff(o) > 0]
        cut[full] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(data)).astype(np.int32)
        first = np.searchsorted(starts, o)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        _, at, data = found.dictionary.buffers()
        at, data, index = np.frombuffer(at, np.int32)[: len(found.dictionary) + 1].tolist(), data.to_pybytes() if data else b"", found.indices.to_numpy()
        distinct = [data[a:b] for a, b in itertools.pairwise(at)]
        if len(self.known) + len(distinct) > WORDS_KEPT:
            self.forget()
        at = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            new = [distinct[i] for i in missing]
            self.learn(new)
            at[missing] = [self.known[x] for x in new]
        at = at[index]
        source, count = self.at[at], self.at[at + 1] - self.at[at]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        bounds = np.append(0, upto)[first] + np.arange(len(first))  # one more id for each text before
        out = np.full(total + len(o) - 1, end, "<u4")
        doc = np.repeat(np.arange(len(o) - 1), np.diff(bounds) - 1)
        i = np.arange(total)
        out[i + doc] = self.pool[i + np.repeat(source - upto + count, count)]
        return out, bounds


@dataclass
class Grammar:
    """A compressed sequence: symbols below ``first`` are ids, first + i stands for the pair rules[i]."""

    first: int
    rules: np.ndarray  # uint32, n x 2
    lengths: np.ndarray  # int64, of each rule's expansion
    symbols: np.ndarray  # uint32
    last: np.ndarray  # bool, where a document ends


def compress(ids: np.ndarray, last: np.ndarray, frequent: int = 16, least_gain: float = 0.005) -> Grammar:
    """The Re-Pair grammar of ids, of which no pair begins where ``last`` is set. A round replaces all pairs that
    occur ``frequent`` times (where they don't overlap better ones, or themselves); the last round is one that has none or
    shortens the sequence by less than least_gain. A pair that was not frequent never becomes so, hence a round looks
    only at places with a symbol of the round before and at those whose frequent pair lost to one beside it."""
    first = top = int(ids.max(initial=0)) + 1
    sequence, last = ids.astype(np.uint32), last.copy()
    active = np.ones(max(0, len(sequence) - 1), bool)
    rules: list[np.ndarray] = []
    lengths = np.ones(first, np.int64)  # of all symbols
    while len(sequence) > 1:
        size = len(sequence)
        place, pair = _grouped(sequence, np.flatnonzero(active & ~last[:-1]), top)
        edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(pair)))
        inside = count >= frequent
        many = np.flatnonzero(inside)
        if not len(many):
            break
        order = np.argsort(-count[many], kind="stable")
        rank = np.empty(len(many), np.int32)
        rank[order] = np.arange(len(many), dtype=np.int32)
        every = np.full(size + 1, _NONE, np.int32)  # of the pair at each place its rank
        every[place[np.repeat(inside, count)]] = np.repeat(rank, count[many])
        mine = every
        again = (every[1:] == every[:-1]) & (every[1:] != _NONE)
        if again.any():  # one symbol again and again: its pairs at every other place
            at = np.arange(size + 1, dtype=np.int32)
            begin = at.copy()
            begin[1:][again] = 0
            mine = np.where((at - np.maximum.accumulate(begin)) & 1, _NONE, every)
        won = (mine[:-1] <= mine[1:]) & (mine[:-1] != _NONE)
        won[1:] &= mine[1:-1] < mine[:-2]
        taken = np.flatnonzero(won)
        chosen = mine[taken]
        good = np.bincount(chosen, minlength=len(many)) >= frequent
        taken, chosen = taken[good[chosen]], chosen[good[chosen]]
        if not len(taken):
            break
        name = (np.cumsum(good) - 1 + top).astype(np.uint32)
        pairs = sequence[place[edge[many[order]]][good][:, None] + np.array([0, 1])]
        rules.append(pairs)
        lengths = np.concatenate([lengths, lengths[pairs[:, 0]] + lengths[pairs[:, 1]]])
        top += len(pairs)
        sequence[taken] = name[chosen]
        last[taken] = last[taken + 1]
        lost = every[:-1] != _NONE
        lost[taken] = False
        new, stay = np.zeros(size, bool), np.ones(size, bool)
        new[taken], stay[taken + 1] = True, False
        sequence, last, new, lost = sequence[stay], last[stay], new[stay], lost[stay]
        active = new[:-1] | new[1:] | lost[:-1]
        if len(taken) < least_gain * size:
            break
    return Grammar(first, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths[first:], sequence, last)


def _grouped(sequence: np.ndarray, place: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and the pairs that begin there, equal pairs together and in order of places."""
    if top < 1 << _SYMBOLS and len(sequence) < 1 << _PLACES:  # a pair and its place fit one key
        keys = sequence[place].astype(np.uint64)
        keys <<= np.uint64(_SYMBOLS)
        keys |= sequence[place + 1]
        keys <<= np.uint64(_PLACES)
        keys |= place.astype(np.uint64)
        keys.sort()
        place = keys.astype(np.uint32) & np.uint32((1 << _PLACES) - 1)
        keys >>= np.uint64(_PLACES)
        return place, keys
    pair = sequence[place].astype(np.uint64) << np.uint64(32) | sequence[place + 1]
    order = np.argsort(pair, kind="stable")
    return place[order], pair[order]


def expand(symbols: np.ndarray, first: int, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for, level by level."""
    while True:
        pair = symbols >= first
        if not pair.any():
            return symbols
        at = np.arange(len(symbols)) + np.cumsum(pair) - pair
        out = np.empty(len(symbols) + int(pair.sum()), np.uint32)
        out[at] = symbols
        both = rules[symbols[pair] - np.uint32(first)]
        out[at[pair]], out[at[pair] + 1] = both[:, 0], both[:, 1]
        symbols = out


def expand_all(symbols: np.ndarray, first: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of a whole shard: the expansions of all rules, then one gather. A rule occurs ``frequent`` times when it is
    made, so the expansions of a round's rules are a fraction of the ids."""
    pool = np.concatenate([expand(rules.ravel(), first, rules), np.zeros(1, np.uint32)])
    pair = symbols >= first
    rule = np.where(pair, symbols, first).astype(np.int64) - first
    lengths = np.append(lengths, 1)
    count = np.where(pair, lengths[rule], 1)
    begin = np.where(pair, (np.cumsum(lengths) - lengths)[rule], 0)
    upto = np.cumsum(count)
    out = pool[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - upto + count, count)]
    out[(upto - count)[~pair]] = symbols[~pair]
    return out


def to_bytes(keys: list[int | None], counts: np.ndarray, g: Grammar) -> bytes:
    if len(g.rules) + g.first >= 1 << 24:
        raise ValueError("more symbols than three bytes tell apart")
    ends = np.flatnonzero(g.last)
    body = b"".join((
        _HEAD.pack(MAGIC, len(keys), int(counts.sum()), len(g.symbols), len(g.rules), g.first),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is not None for k in keys], "u1").tobytes(), counts.astype("<u8").tobytes(), np.diff(ends, prepend=-1).astype("<u8").tobytes(),
        g.rules.astype("<u4").tobytes(), g.lengths.astype("<u8").tobytes(), np.ascontiguousarray(g.symbols.astype("<u4").view("u1").reshape(-1, 4)[:, :3]).tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard's head; symbols are read where they are needed."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.docs, self.ids, self.size, n, self.first = _HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.data, kind, count, at)
            at += out.nbytes
            return out

        keys, has = take("<i8", self.docs), take("u1", self.docs)
        self.keys = [k if h else None for k, h in zip(keys.tolist(), has.tolist(), strict=True)]
        self.counts, self.spans = take("<u8", self.docs).astype(np.int64), take("<u8", self.docs).astype(np.int64)
        self.rules, self.lengths = take("<u4", 2 * n).reshape(-1, 2), take("<u8", n).astype(np.int64)
        self.at = at

    def check(self) -> None:
        if zlib.crc32(self.data[:-4]) != struct.unpack("<I", self.data[-4:])[0]:
            raise ValueError("a shard of token ids is damaged")

    def symbols(self, lo: int, hi: int) -> np.ndarray:
        three = np.frombuffer(self.data, "u1", 3 * (hi - lo), self.at + 3 * lo).reshape(-1, 3)
        out = np.zeros((hi - lo, 4), "u1")
        out[:, :3] = three
        return out.view("<u4").ravel()

    def all_ids(self) -> np.ndarray:
        return expand_all(self.symbols(0, self.size), self.first, self.rules, self.lengths)

    def window(self, doc: int, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of a document, from the symbols that cover them."""
        begin = int(self.spans[:doc].sum())
        symbols = self.symbols(begin, begin + int(self.spans[doc]))
        lo, hi = max(0, lo), min(hi, int(self.counts[doc]))
        ends = np.cumsum(np.where(symbols < self.first, 1, self.lengths[np.maximum(symbols.astype(np.int64) - self.first, 0)] if len(self.lengths) else 1))
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.first, self.rules)[lo - before : hi - before] if lo < hi else symbols[:0]


_MANIFEST = "part int, shard int, file string, at long, bytes long, docs long, ids long, symbols long, rules long"
_MANIFEST_NAMES = [c.split()[0] for c in _MANIFEST.split(", ")]


def write(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, end: int = 0, shard_ids: int = SHARD_IDS, file_bytes: int = FILE_BYTES, frequent: int = 16) -> DataFrame:
    """Write all texts' ids in ascending order of keys and return the manifest: part, shard (in that order), file, at, bytes,
    docs, ids, symbols, rules.

    Null texts are empty, each document has its end id. Null keys come last; rows of one key are in the order of their texts'
    hashes. A document is never cut: a shard has at least one. An empty table gives no shards. Other columns are not looked at.
    """
    spark = docs.sparkSession
    where = common.arrow_uri(spark, common.scratch(spark, "tokens"))

    def run(batches):
        from pyspark import TaskContext

        file = path or packing.vocabulary(VOCABULARY)
        encoder = _ENCODERS.get(file) or _ENCODERS.setdefault(file, Encoder(file))
        store, top = pafs.FileSystem.from_uri(where)
        store.create_dir(top, recursive=True)
        part, made, keys, parts = TaskContext.get().partitionId(), [], [], []
        out = None

        def flush():
            nonlocal out, keys, parts
            if out is None:
                name = f"{top}/{uuid.uuid4().hex}.tokens"
                out = (name, store.open_output_stream(name))
            ids = np.concatenate([a for a, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            last = np.zeros(len(ids), bool)
            last[np.cumsum(counts) - 1] = True
            g = compress(ids, last, frequent)
            data, at = to_bytes(keys, counts, g), out[1].tell()
            out[1].write(data)
            made.append((part, len(made), out[0], at, len(data), len(keys), len(ids), len(g.symbols), len(g.rules)))
            keys, parts = [], []
            if out[1].tell() >= file_bytes:
                out[1].close()
                out = None

        for batch in batches:
            data, off = words.texts(batch.column(1))
            given = batch.column(0).to_pylist()
            for lo, hi in words.slices(off, SLICE):
                ids, bounds = encoder.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end)
                keys += given[lo:hi]
                parts.append((ids, np.diff(bounds)))
                if sum(len(a) for a, _ in parts) >= shard_ids:
                    flush()
        if keys:
            flush()
        if out is not None:
            out[1].close()
        columns = list(zip(*made, strict=True)) or [()] * len(_MANIFEST_NAMES)
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _MANIFEST_NAMES)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("key").asc_nulls_last(), "tie", "row"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(docs) >> 26)
    return common.materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("key", "text").mapInArrow(common.trimmed(run), _MANIFEST), "manifest")


_ENCODERS: dict[str, Encoder] = {}


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the number of ids of all shards before: totals of parts first (a row a
    task of the writer), then inside each part."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("inside", inside).join(before, "part").withColumn("start", F.col("first") + F.col("inside")).drop("first", "inside")


def _open(file: str, at: int, size: int, where: str) -> bytes:
    store, _ = pafs.FileSystem.from_uri(where)
    with contextlib.closing(store.open_input_file(file)) as f:
        return f.read_at(size, at)


def read(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """A row a document, from the files: key, start (ids of all documents before), n_tokens, ids_crc32, and with ``ids``
    the ids as little-endian uint32 bytes. A damaged shard is an error."""
    spark = manifest.sparkSession
    where = common.arrow_uri(spark, common.shared_dir(spark))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(_open(r["file"], r["at"], r["bytes"], where))
                shard.check()
                whole = shard.all_ids().astype("<u4", copy=False)
                ends = np.cumsum(shard.counts)
                begins = ends - shard.counts
                cut = [memoryview(whole[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                for lo in range(0, len(cut), 4096):
                    some = cut[lo : lo + 4096]
                    columns = [pa.array(shard.keys[lo : lo + 4096], pa.int64()), pa.array(begins[lo : lo + 4096] + r["start"]), pa.array(shard.counts[lo : lo + 4096]), pa.array([zlib.crc32(x) for x in some], pa.int64())]
                    columns += [pa.array([bytes(x) for x in some], pa.binary())] if ids else []
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    rows = placed(manifest).select("file", "at", "bytes", "start")
    tasks = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartition(tasks).mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def window(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, lo, hi, ids): ids lo to hi (not with it) of each wanted document, whose columns are file, at, bytes (its shard's, from
    the manifest), key, lo, hi. Each shard that is asked for is read once, only the windows' symbols are expanded; a key that the
    shard doesn't have gives no row."""
    where = common.arrow_uri(manifest.sparkSession, common.shared_dir(manifest.sparkSession))

    def run(batches):
        held = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                name = (r["file"], r["at"])
                if held is None or held[0] != name:
                    shard = Shard(_open(r["file"], r["at"], r["bytes"], where))
                    held = (name, shard, {k: i for i, k in enumerate(shard.keys)})
                doc = held[2].get(r["key"])
                if doc is not None:
                    rows.append((r["key"], r["lo"], r["hi"], held[1].window(doc, r["lo"], r["hi"]).tolist()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["key", "lo", "hi", "ids"])

    return wanted.select("file", "at", "bytes", "key", "lo", "hi").repartition("file", "at").sortWithinPartitions("file", "at").mapInArrow(run, "key long, lo long, hi long, ids array<long>")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(common.table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


ORACLE: dict[str, str] = {}
QUERIES = {"op13_token_files": op13_token_files}
