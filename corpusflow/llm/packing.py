"""Best-fit packing in bulk-synchronous rounds over range-sorted documents and gaps.

Pieces are packed band by band, the longest first. A band is a run of fits; a piece's fit is
how many of its size a sequence holds. A band is packed in rounds:

1. Slots. Each sequence with room for the band's shortest piece offers slots: as many of the
   band's greatest length as fit, the last one wider by what is left.
2. Sweep. Slots and pieces are range-sorted together, longest first, slots before pieces of
   their size. Every piece takes its successor, the smallest slot not shorter than it that no
   piece before it took: the innermost slot still open, as brackets match. A partition matches
   what it can by a stack of its own. What stays open has a depth, known from the other
   partitions' numbers of open slots and pieces; a piece and the slot it takes have one depth
   and stand next to each other among all of that depth.
3. Conflicts can't occur: a slot is at one depth once, and pieces are told apart by
   rank (size, key, piece).
4. Gaps. Pieces go to their sequences in the order of slots; the gaps that took some shrink.

Rounds go on while they place half of what is left; else as many empty sequences are opened
as hold all of it, and later, shorter bands fill their ends. So a band takes at most as many
rounds as its number of pieces has binary digits, in practice two or three. All state is in
tables of the shared folder; the driver has counts only.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common, words

VOCABULARY = "word_bpe_49k.json"
WORDS_KEPT = 700_000  # distinct words whose ids a worker remembers
SLICE = 2 << 20
BANDS = (1, 2, 3, 4, 6, 10, 20, 64)
_SEPARATOR, _SEPARATOR_ID = "<|startoftext|>", 49406
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


class Encoder:
    """Token ids of whole texts.

    The vocabulary drops white space, no token spans it, and A-Z count as a-z. So the
    ids of a text are those of its words, one after another; a mark after a letter at a
    word's end is a word of its own. Each distinct word of a slice (Arrow's dictionary
    encoding finds them) is looked up, or encoded with many others at once, and the ids
    are gathered in numpy. Texts with ``<|``, which may spell a special token, are
    encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.at = np.zeros(1 << 12, np.int64)  # of each known word, its first id in the pool and then their end

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, some: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        """ids: of all these words, one after another."""
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
            (plain if x.decode(errors="replace").isalpha() else other).append(x)
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = self._ids(b" ".join(some).decode())
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):  # each word's last token tells its end
                self._keep(some, ids, np.diff(ends, prepend=0))
            else:
                other += some
        for at in range(0, len(other), 512):
            some = other[at : at + 512]
            ids = self._ids(_SEPARATOR.join([x.decode() for x in some]))
            between = ids == _SEPARATOR_ID
            self._keep(some, ids[~between], np.bincount(np.cumsum(between)[~between], minlength=len(some)))

    def encode(self, data: np.ndarray, o: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, each with end behind, and the first of each."""
        raw = data.tobytes()
        if b"<|" in raw:
            rows = [np.append(self._ids(raw[a:b].decode()), np.uint32(end)).astype("<u4") for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            return np.concatenate(rows), np.append(0, np.cumsum([len(x) for x in rows]))
        buf = words.lowered(data)
        starts, ends = words.spans(buf, o)
        first = np.searchsorted(starts, o)
        split = _MARK[buf[ends - 1]] & (ends - starts > 1)
        before = buf[ends[split] - 2]
        split[split] = (before >= 97) & (before <= 122)
        # a word that is split has two places, its mark the second one
        place = np.arange(len(starts)) + np.cumsum(split) - split
        lengths = np.ones(len(starts) + int(split.sum()), np.int64)
        lengths[place] = ends - starts - split
        first = np.append(place, len(lengths))[first]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        content = buf[words.inside(buf)]
        found = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(content)]).dictionary_encode()
        distinct, index = found.dictionary.to_pylist(), found.indices.to_numpy()
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
        doc = np.repeat(np.arange(len(o) - 1, dtype=np.int32), np.diff(first))
        i = np.arange(total, dtype=np.int32)
        out[i + np.repeat(doc, count)] = self.pool[i + np.repeat((source - upto + count).astype(np.int32), count)]
        return out, bounds


_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, end: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of each document's ids and then id ``end``.
    Only documents of more than capacity ids are cut, into pieces of capacity."""

    def run(batches):
        file = path or vocabulary()
        encoder = _ENCODERS.get(file) or _ENCODERS.setdefault(file, Encoder(file))
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, off = words.texts(batch.column(1))
            out: list[tuple] = []
            for lo, hi in words.slices(off, SLICE):
                ids, bounds = encoder.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end)
                for k, a, b in zip(keys[lo:hi], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    out += [(k, i, at - a, min(capacity, b - at), zlib.crc32(ids[at : min(b, at + capacity)])) for i, at in enumerate(range(a, b, capacity))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["key", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(common.trimmed(run), "key long, piece int, start long, length long, ids_crc32 long")


def _match(batches):
    """Rows of a partition, longest first: pieces with the slot they take here, and what stays
    open with its number, from 0: pieces in their order, slots from the widest."""
    from pyspark import TaskContext

    stack: list[tuple] = []
    free, part = 0, TaskContext.get().partitionId()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(_LOCAL)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LOCAL, strict=True)], schema=_LOCAL)

    for batch in batches:
        rows = []
        for slot, key, piece, start, length, crc, seq, at, used in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if slot:
                stack.append((seq, at, used))
            elif stack:
                rows.append((part, "placed", None, key, piece, start, length, crc, *stack.pop()))
            else:
                rows.append((part, "piece", free, key, piece, start, length, crc, None, None, None))
                free += 1
        yield out(rows)
    yield out([(part, "slot", i, None, None, None, None, None, *s) for i, s in enumerate(stack)])


_FIELDS = ["key", "piece", "start", "length", "ids_crc32"]
_PIECE = "key long, piece int, start long, length long, ids_crc32 long"
_LOCAL = pa.schema(
    [("part", pa.int32()), ("kind", pa.string()), ("no", pa.int64()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("used", pa.int64())]
)


def sweep(items: DataFrame, slots: DataFrame) -> DataFrame:
    """items with seq, at, used of the slot each takes, or nulls. items: columns of pieces;
    slots: seq, at (the slot's number in it), used (tokens in seq), size."""
    nothing = [F.lit(None).cast("long").alias(c) for c in ("seq", "at", "used")]
    left = items.select(F.lit(False).alias("slot"), *_FIELDS, *nothing, F.col("length").alias("size"))
    right = slots.select(F.lit(True).alias("slot"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _PIECE.split(", "))], "seq", "at", "used", "size")
    order = [F.desc("size"), F.desc("slot"), F.col("key"), F.col("piece"), F.col("start"), F.col("ids_crc32"), F.col("seq"), F.col("at")]
    both = left.unionByName(right).repartitionByRange(*order).sortWithinPartitions(*order).drop("size")
    local = common.materialise(both.mapInArrow(_match, "part int, kind string, no long, " + _PIECE + ", seq long, at long, used long"), "swept")
    # of each partition: open pieces, then open slots; a row for each partition
    per = local.filter("kind <> 'placed'").groupBy("part").agg(F.count_if(F.col("kind") == "piece").alias("u"), F.count_if(F.col("kind") == "slot").alias("g"))
    before = "rows between unbounded preceding and 1 preceding"
    per = per.selectExpr("part", "u", f"coalesce(sum(g - u) over (order by part {before}), 0) as s")
    per = per.selectExpr("part", "u", "s", f"least(0, min(s - u) over (order by part {before})) as floor_before", "least(0, min(s - u) over (order by part)) as floor")
    level = F.expr("case kind when 'piece' then s - floor_before - no else s - u - floor + no + 1 end")
    open_ = local.filter("kind <> 'placed'").join(F.broadcast(per), "part").withColumn("level", level)
    # at one depth slots and pieces alternate; a partition's pieces come before its slots
    at = W.partitionBy("level").orderBy("part", F.when(F.col("kind") == "piece", 0).otherwise(1))
    crossed = open_.filter("level > 0").withColumn("slot", F.lag(F.struct("seq", "at", "used")).over(at)).filter("kind = 'piece'")
    columns = [*_FIELDS, "seq", "at", "used"]
    placed = local.filter("kind = 'placed'").select(columns)
    return placed.unionByName(crossed.select(*_FIELDS, "slot.seq", "slot.at", "slot.used")).unionByName(open_.filter("kind = 'piece' and level <= 0").select(columns))


def pack(found: DataFrame, capacity: int = 2048, bands: tuple[int, ...] = BANDS, share: float = 0.5) -> DataFrame:
    """pieces with sequence_id and offset; no piece may be longer than capacity or empty.

    Ties (equal sizes) go by key and piece; repeated rows are pieces of their own; an empty table
    gives no rows. bands: the least fit of each band, from 1. Sequences are opened where a
    round places less than ``share`` of the pieces it had. found is read once a band and should
    be materialised. A sequence has no gap but at its end.
    """
    spark, found = found.sparkSession, found.select(_FIELDS)
    fit = F.floor(F.lit(capacity) / F.col("length"))
    band = F.size(F.filter(F.array(*[F.lit(x) for x in bands]), lambda x: x <= fit)) - 1
    waiting = {r[0]: r[1] for r in found.groupBy(band).agg(F.count(F.lit(1))).collect()}
    done: list[DataFrame] = []
    gaps, opened = common.empty(spark, "seq long, used long"), 0
    room, behind = F.lit(capacity) - F.col("used"), W.partitionBy("seq").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    for b in sorted(waiting):
        most, least = capacity // bands[b], 1 if b == len(bands) - 1 else capacity // bands[b + 1] + 1
        left, rest = found.filter(band == b), waiting[b]
        fresh = rest if opened else 0
        while rest:
            if fresh < share * (fresh + rest):
                more = -(-rest // bands[b])
                gaps = gaps.unionByName(spark.range(opened, opened + more).select(F.col("id").alias("seq"), F.lit(0).cast("long").alias("used")))
                opened += more
            slots = gaps.filter(room >= least).select("seq", "used", room.alias("room"), F.greatest(F.floor(room / most), F.lit(1)).alias("m"))
            slots = slots.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("at"))
            slots = slots.select("seq", "at", "used", F.when(F.col("at") < F.col("m") - 1, F.lit(most)).otherwise(F.col("room") - (F.col("m") - 1) * most).cast("long").alias("size"))
            swept = sweep(left, slots)
            seated = swept.filter("seq is not null").withColumn("offset", F.col("used") + F.coalesce(F.sum("length").over(behind), F.lit(0)))
            kept = [*_FIELDS, "seq", "offset"]
            swept = common.materialise(seated.select(kept).unionByName(swept.filter("seq is null").withColumn("offset", F.lit(None).cast("long")).select(kept)), "round")
            placed, left = swept.filter("seq is not null"), swept.filter("seq is null").select(_FIELDS)
            fresh, rest = swept.agg(F.count("seq"), F.count_if(F.col("seq").isNull())).first()
            done.append(placed)
            filled = placed.groupBy("seq").agg(F.max(F.col("offset") + F.col("length")).alias("upto"))
            gaps = common.materialise(gaps.join(filled, "seq", "left").select("seq", F.coalesce("upto", "used").alias("used")).filter(F.col("used") < capacity), "gaps")
    out = done[0] if done else found.withColumns({"seq": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("seq", "sequence_id")


def pack_documents(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Each piece of each document and its place. Null text counts as empty: one id.
    Very long texts are cut, not shortened. Repeated rows are packed as often as they come; equal
    sizes go by key and piece; an empty table gives no rows. Other columns of docs are not
    looked at."""
    found = common.materialise(pieces(docs, capacity, path), "pieces")
    return pack(found, capacity).withColumnRenamed("key", "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE: dict[str, str] = {}
