"""Joins that have no operator of their own: nearest in time, greedy pairs, first match."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import ship, small, written


def nearest_within(left: DataFrame, right: DataFrame, seconds: int, per: str = "source") -> DataFrame:
    """left (id, start), right (source, id, start) -> (id, source, match, gap): for each
    source the nearest record within so many seconds; ties go to the least id. A row without
    a start matches nothing.

    What is nearest depends on a row's second alone, so seconds are told apart first, and of the right rows of a source
    and second only the least id counts. A window over each source's bucket of that width finds the ones before and
    after a second, with the last one of the bucket before and the first one of the bucket after set beside. No pair but
    the answers is made, and a bucket has at most as many rows as seconds, however many records it has."""
    per_bucket = W.partitionBy("source", "b")
    t = lambda c: F.unix_timestamp(c)
    l = left.filter("start is not null").select("id", t("start").alias("t"))  # noqa: E741
    least = F.when(F.count_if(F.col("match").isNull()) == 0, F.min("match")).alias("match")  # a row without an id is the least
    bucket = lambda c: F.floor(F.col(c) / seconds) if seconds else F.col(c)
    r = right.filter("start is not null").select(F.col(per).alias("source"), F.col("id").alias("match"), t("start").alias("u")).groupBy("source", "u").agg(least).withColumn("b", bucket("u"))
    ends = r.withColumns({"first": F.min("u").over(per_bucket), "last": F.max("u").over(per_bucket)})
    at = F.array_compact(F.array(F.col("b"), F.when(F.col("u") == F.col("last"), F.col("b") + 1), F.when(F.col("u") == F.col("first"), F.col("b") - 1)))
    places = ends.select("source", "u", "match", F.explode(at).alias("b"))
    asked = l.select("t").distinct().withColumn("b", bucket("t")).join(places.select("b", "source").distinct(), "b")
    both = places.select("b", "source", F.col("u").alias("t"), F.struct("u", "match").alias("p")).unionByName(asked.select("b", "source", "t"), allowMissingColumns=True)
    order = per_bucket.orderBy("t")
    before, after = F.last("p", True).over(order.rangeBetween(W.unboundedPreceding, W.currentRow)), F.last("p", True).over(per_bucket.orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, W.currentRow))
    gap = lambda p: F.abs(F.col("t") - p["u"])
    near = F.array_min(F.filter(F.array(*[F.struct(gap(F.col(c)).alias("gap"), F.col(c)["match"].alias("match")) for c in ("before", "after")]), lambda x: x["gap"] <= seconds))
    answers = both.withColumns({"before": before, "after": after}).filter("p is null").select("t", "source", near.alias("m")).filter("m is not null")
    best = l.join(answers, "t").groupBy("id", "source").agg(F.min("m").alias("m"))
    return best.select("id", "source", F.col("m.match").alias("match"), F.col("m.gap").alias("gap"))


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with ``name``: each row's place in the order given, from 1. The order should tell all rows apart, so that a range
    sort can cut it anywhere. No task gets all rows: partitions' numbers of rows give each one's first place."""
    part, row = f"__part_{name}", f"__row_{name}"
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the row in it below
    kept = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({part: F.shiftright(at, 33), row: at.bitwiseAND((1 << 33) - 1)}), "numbered")
    before = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    first = kept.groupBy(part).agg(F.count(F.lit(1)).alias("__n")).select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return kept.join(F.broadcast(first), part).withColumn(name, F.col(row) + F.col("__first") + 1).drop(part, row, "__first")


#: Rows of a block of greedy_pairs: what a task holds at once.
BLOCK = 50_000


def greedy_pairs(left: DataFrame, right: DataFrame, seconds: int, kind: str = "long", rounds: int = 8, block: int = BLOCK) -> DataFrame:
    """left (id, start, ordinal), right (id, start), ids of ``kind`` -> (left_id, right_id): in the order of ordinals and
    then ids, each left row takes the nearest right row within so many seconds that is still free (of equally near ones
    the least id). Rows without a start match nothing; ids are expected to be unique on each side.

    Rows of both sides are cut by time into blocks of so many rows, and a task settles what a block tells without
    its neighbours (``_settle``): all but the rows that hang together with those beyond its ends. These few are cut into blocks
    again, until none is open. Where a round leaves more than half of the left rows open (most rows of one
    second, a chain longer than blocks), the rest is paired by proposals."""
    ship(left.sparkSession)
    second = lambda df: df.select("id", F.unix_timestamp("start").alias("t"), *[F.col(c).cast("long") for c in df.columns if c == "ordinal"]).filter("t is not null")
    rows = second(left).withColumn("side", F.lit(1)).unionByName(second(right).withColumn("side", F.lit(0)), allowMissingColumns=True).select("side", F.col("id").cast(kind).alias("id"), "t", "ordinal")
    done, before = None, None
    while True:
        judged = _blocks(rows, seconds, block, kind)
        pairs = judged.filter("side = 2").select(F.col("id").alias("left_id"), F.col("rid").alias("right_id"))
        done = pairs if done is None else done.unionByName(pairs)
        rows = judged.filter("side < 2").drop("rid")
        n = judged.agg(F.count_if(F.col("side") == 1).alias("open"), F.count_if(F.col("side") == 2).alias("pairs")).first()
        if not n.open:
            return done
        if 2 * n.open > (n.open + n.pairs if before is None else before):
            sides = [rows.filter(F.col("side") == s).drop("side") for s in (1, 0)]
            return done.unionByName(_proposed(sides[0], sides[1].drop("ordinal").withColumnRenamed("id", "rid"), seconds, kind, rounds))
        before = n.open


def _blocks(rows: DataFrame, seconds: int, block: int, kind: str) -> DataFrame:
    """rows (side, id, t, ordinal) as ``_settle`` leaves them, block by block."""
    placed = numbered(rows, ["t", "side", "ordinal", "id"], "row").select("side", "id", "t", "ordinal", F.floor((F.col("row") - 1) / block).alias("block"))
    ends = placed.groupBy("block").agg(F.min("t").alias("low"), F.max("t").alias("high"))  # a row a block
    next_to = ends.select("block", F.lag("high").over(W.orderBy("block")).alias("low"), F.lead("low").over(W.orderBy("block")).alias("high"))
    tasks = max(1, min(10_000, ends.count()))
    dealt = placed.join(F.broadcast(next_to), "block").repartition(tasks, "block")
    return written(dealt.groupBy("block").applyInArrow(lambda table: _settle(table, seconds), f"side int, id {kind}, rid {kind}, t bigint, ordinal bigint"), "settled")


def _settle(rows: pa.Table, seconds: int) -> pa.Table:
    """A block's rows (side: 1 left, 0 right; id, t, ordinal; low and high: the times next to the block, null without) -> pairs
    (side 2: id, rid) and the rows that are left: of side 1 those that are open, of side 0 those free that an open
    row, here or beyond the ends, may reach.

    Left rows come in their order. A right row is free, taken or in doubt: rows beyond an end may take
    what is so near to it. Where the nearest one not taken is free, and nearer than an end, that is the pair whatever happens elsewhere.
    Else the row stays open, and what it takes is in doubt already or the nearest free one, which is in doubt from now on. A
    pair may be taken out for those still open too: it was free for them and they had better ones."""
    side = rows["side"].to_numpy()
    low, high = (rows[c][0].as_py() for c in ("low", "high"))
    lefts, rights = rows.filter(pa.array(side == 1)), rows.filter(pa.array(side == 0))
    lefts = lefts.take(pc.sort_indices(lefts, [("ordinal", "ascending"), ("id", "ascending")], null_placement="at_start"))
    rights = rights.take(pc.sort_indices(rights, [("id", "ascending")]))  # from now on a number orders as its id
    u, t = rights["t"].to_numpy().astype(np.int64), lefts["t"].to_numpy().astype(np.int64)
    n, far = len(u), 1 << 62
    near_end = np.zeros(n, bool)
    to_end = np.full(len(t), far)
    for end in (low, high):
        if end is not None:
            near_end |= np.abs(u - end) <= seconds
            to_end = np.minimum(to_end, np.abs(t - end))
    # both ways from a time: right rows by time and number, those at the time itself among the ones before
    up, down = np.lexsort((np.arange(n), u)), np.lexsort((np.arange(n), -u))
    from_up, from_down = np.searchsorted(u[up], t, "right").tolist(), np.searchsorted(-u[down], -t, "left").tolist()
    orders = [[*up.tolist(), -1], [*down.tolist(), -1]]
    places = [np.argsort(o).tolist() for o in (up, down)]
    times = u.tolist()
    doubt = near_end.tolist()
    # of each place the next one, itself included, that is not taken; and that is free
    untaken = [list(range(n + 1)) for _ in orders]
    free = [np.where(np.append(near_end[o], False), np.arange(1, n + 2), np.arange(n + 1)).tolist() for o in (up, down)]

    def find(follow: list[int], i: int) -> int:
        while follow[i] != i:
            follow[i] = i = follow[follow[i]]
        return i

    def nearest(follow: list[list[int]], at: int, k: int) -> tuple[int, int]:
        """(gap, number); n where there is none within reach"""
        best = (seconds, n)
        for follows, order, start in zip(follow, orders, (from_up[k], from_down[k]), strict=True):
            r = order[find(follows, start)]
            if r >= 0 and (found := (abs(times[r] - at), r)) < best:
                best = found
        return best

    def leave(follow: list[list[int]], r: int) -> None:
        for follows, place in zip(follow, places, strict=True):
            follows[place[r]] = place[r] + 1

    partner, open_ = np.full(len(t), -1), np.zeros(len(t), bool)
    for k, (at, end) in enumerate(zip(t.tolist(), to_end.tolist(), strict=True)):
        gap, r = nearest(untaken, at, k)
        if r < n and not doubt[r] and gap < end:
            partner[k] = r
            leave(untaken, r)
            leave(free, r)
        elif r < n or end <= seconds:
            open_[k] = True
            r = nearest(free, at, k)[1]
            if r < n:
                doubt[r] = True
                leave(free, r)
    still = np.ones(n, bool)
    still[partner[partner >= 0]] = False
    asked = np.sort(t[open_])
    still &= near_end | (np.searchsorted(asked, u - seconds, "left") < np.searchsorted(asked, u + seconds, "right"))
    paired = np.flatnonzero(partner >= 0)
    kinds = rows["id"].type
    one = lambda s, ids, rids, ts, ordinals: pa.table({"side": pa.array(np.full(len(ids), s, np.int32)), "id": ids, "rid": rids, "t": ts, "ordinal": ordinals})
    none = lambda kind, m: pa.nulls(m, kind)
    kept, left_ = rights.filter(pa.array(still)), lefts.filter(pa.array(open_))
    return pa.concat_tables([
        one(2, lefts["id"].take(pa.array(paired)), rights["id"].take(pa.array(partner[paired])), none(pa.int64(), len(paired)), none(pa.int64(), len(paired))),
        one(1, left_["id"], none(kinds, len(left_)), left_["t"], left_["ordinal"]),
        one(0, kept["id"], none(kinds, len(kept)), kept["t"], none(pa.int64(), len(kept))),
    ])


def _proposed(lefts: DataFrame, rights: DataFrame, seconds: int, kind: str, rounds: int) -> DataFrame:
    """lefts (id, t, ordinal), rights (rid, t) -> (left_id, right_id) as greedy_pairs has them, without blocks.

    As that order is the same for all right rows, the pairs are those of deferred acceptance, which needs no turns: in a round every open
    left row proposes to its nearest right row that has not refused it; a right row holds the first proposer in
    the order, also in place of one it held, and refuses the others, which are open again. It ends when none is open.

    A left row's choices are two runs of right rows, before and after it in time, so its state is how many of either have refused
    it. Right rows are numbered both ways by range sorts, and a proposal is an equi join on such a number: no pair is made
    that isn't proposed. Of left rows at one time and in one state the k-th proposes to their k-th choice at once: the
    ones before it in the order get better ones whatever happens. Pairs before the first open row are final: every few rounds,
    where they are most of the pairs, the others are numbered again without them. Rounds are bounded by the longest chain
    of refusals; each reads and writes the open rows and the pairs held in the shared folder.
    """
    done = None
    pairs = lambda df: df.select(F.col("id").alias("left_id"), F.col("rid").alias("right_id"))
    while True:
        places, open_, held = _numbered_sides(lefts, rights, kind)
        while True:
            for _ in range(rounds):
                if open_.isEmpty():
                    return pairs(held) if done is None else done.unionByName(pairs(held))
                held, open_ = _round(places, open_, held, seconds)
            least = open_.agg(F.min(F.struct("ordinal", "id")).alias("m")).first().m
            if least is not None:
                limit = F.struct(F.lit(least.ordinal).cast("long").alias("ordinal"), F.lit(least.id).cast(kind).alias("id"))
                before = F.struct("ordinal", "id") < limit
                n = held.agg(F.count(F.lit(1)).alias("all"), F.count_if(before).alias("final")).first()
                if 2 * n.final >= n.all:
                    break
        final = held.filter(before)
        done = pairs(final) if done is None else done.unionByName(pairs(final))
        rights = written(rights.join(final.select("rid"), "rid", "left_anti"), "rights")
        lefts = written(lefts.filter(~before), "lefts")


def _numbered_sides(lefts: DataFrame, free: DataFrame, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(right rows by their numbers from either end, open rows, no pairs)"""
    up = numbered(free, ["t", "rid"], "place").withColumn("before", F.lit(0))
    down = numbered(free, [F.col("t"), F.col("rid").desc()], "place").withColumn("before", F.lit(1))
    places = written(up.unionByName(down).withColumnRenamed("t", "u"), "places")
    none = free.select(F.lit(0).alias("side"), F.lit(None).cast(kind).alias("id"), "t", F.lit(None).cast("long").alias("ordinal"), F.monotonically_increasing_id().alias("tie"))
    base = _running(lefts.select(F.lit(1).alias("side"), "id", "t", "ordinal").unionByName(none, allowMissingColumns=True))
    open_ = written(base.select("id", "ordinal", "t", "base", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")), "open")
    return places, open_, lefts.sparkSession.createDataFrame([], T.StructType([*open_.schema.fields, T.StructField("rid", places.schema["rid"].dataType)]))


def _round(places: DataFrame, open_: DataFrame, held: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(pairs held, rows that are open) after one more round."""
    same = W.partitionBy("t", "i", "j")
    best = same.orderBy("gap", "rid")
    upto = best.rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = F.abs(F.col("t") - F.col("u"))
    ranked = open_.withColumn("k", F.row_number().over(same.orderBy("ordinal", "id")))
    asks = F.inline(F.array(F.struct(F.lit(1).alias("before"), (F.col("base") - F.col("i") - F.col("k") + 1).alias("place")), F.struct(F.lit(0).alias("before"), (F.col("base") + F.col("j") + F.col("k")).alias("place"))))
    both = ranked.select("t", "i", "j", asks).join(places, ["before", "place"]).withColumn("gap", gap).filter(gap <= seconds)
    listed = both.select("t", "i", "j", "rid", F.row_number().over(best).alias("k"), F.sum("before").over(upto).alias("b"), F.sum(1 - F.col("before")).over(upto).alias("a"))
    asked = ranked.join(listed, ["t", "i", "j", "k"]).select("id", "ordinal", "t", "base", (F.col("i") + F.col("b")).alias("i"), (F.col("j") + F.col("a")).alias("j"), "rid")
    first = W.partitionBy("rid").orderBy("ordinal", "id")
    judged = written(held.unionByName(asked).withColumn("held", F.row_number().over(first) == 1), "judged")
    return judged.filter("held").drop("held"), judged.filter("not held").drop("held", "rid")


def _running(sides: DataFrame) -> DataFrame:
    """Left rows (side 1) with ``base``, the number of right rows (side 0) at their time or before."""
    order = ["t", "side", "ordinal", "id", "tie"]
    at = F.monotonically_increasing_id()
    kept = written(sides.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.shiftright(at, 33), "row": at}), "sides")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    totals = kept.groupBy("part").agg(F.sum(1 - F.col("side")).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.sum(1 - F.col("side")).over(W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow))
    return kept.withColumn("inside", inside).filter("side = 1").join(F.broadcast(totals), "part").withColumn("base", F.col("first") + F.col("inside"))


def first_match(candidates: DataFrame, key: str, *order: str) -> DataFrame:
    """The first candidate of each key by the order given, without a shuffle of all of them:
    a partial minimum."""
    rest = [c for c in candidates.columns if c != key and c not in order]
    best = candidates.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("__m"))
    return best.select(key, *[F.col(f"__m.{c}").alias(c) for c in (*order, *rest)])


def route(items: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """items (id, kind, value, pos), any number for each id; rules (tier, ordinal, kind,
    value, folder) -> (id, tier, folder). The least tier anywhere wins, then the rule's place;
    an item without a match gets default and tier null. Few rules are broadcast, many shuffle."""
    hits = items.join(small(rules), ["kind", "value"]).select("id", "tier", "ordinal", "folder")
    best = first_match(hits, "id", "tier", "ordinal")
    return items.select("id").distinct().join(best, "id", "left").select("id", "tier", F.coalesce("folder", F.lit(default)).alias("folder"))


def match_items(meetings: DataFrame, emails: DataFrame, items: DataFrame, least_tokens: int = 2, least_chars: int = 8) -> DataFrame:
    """meetings (id, title), emails (id, pos, email), items (item, email, name) -> (id, tier,
    item): by the first attendee whose email an item has, else by an item's full name inside
    the title. A name's first word must be a word of the title, which makes the second tier
    an equi join."""
    one = emails.join(items.select("item", "email"), "email").select("id", F.lit(1).alias("tier"), F.col("pos").cast("long").alias("ordinal"), "item")
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    names = items.select("item", norm("name").alias("name")).filter((F.size(F.split("name", " ")) >= least_tokens) & (F.length("name") >= least_chars)).withColumn("word", F.split("name", " ")[0])
    words = meetings.select("id", F.concat(F.lit(" "), norm("title"), F.lit(" ")).alias("title")).withColumn("word", F.explode(F.array_distinct(F.split(F.trim("title"), " "))))
    two = words.join(names, "word").filter(F.contains("title", F.concat(F.lit(" "), F.col("name"), F.lit(" ")))).select("id", F.lit(2).alias("tier"), F.lit(0).cast("long").alias("ordinal"), "item")
    return first_match(one.union(two), "id", "tier", "ordinal", "item").select("id", "tier", "item")


def with_board(routed: DataFrame, matched: DataFrame, items: DataFrame) -> DataFrame:
    """routed (id, tier, folder) with the board context of a meeting's matched item, whatever tier decided:
    matched (id, item), items (item, owner, stage)."""
    return routed.join(matched.select("id", "item").join(items, "item", "left"), "id", "left")


def exactly_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left rows joined to right where a key has one right row, no more."""
    single = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first("target").alias("target")).filter("__n = 1").drop("__n")
    return left.join(single, keys)


def merge_sides(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """A full outer join where the first side's filled values win."""
    a, b = first.alias("a"), second.alias("b")
    columns = [c for c in first.columns if c != key]
    text = dict(first.dtypes)
    pick = lambda c: F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")) if text[c] == "string" else F.col(f"a.{c}"), F.col(f"b.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(c).alias(c) for c in columns])


def attach_transcripts(calls: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls with transcript, and the transcripts (id, ...) that no call has."""
    return calls.join(transcripts, "id", "left"), transcripts.join(calls.select("id"), "id", "left_anti")


def privacy_gate(calls: DataFrame, owners: list[str]) -> tuple[DataFrame, DataFrame]:
    """calls (emails, private) -> those kept, and (reason, n) of those dropped: counted,
    never named."""
    mine = F.arrays_overlap(F.transform("emails", F.lower), F.array(*[F.lit(o.lower()) for o in owners]))
    reason = F.when(~F.coalesce(mine, F.lit(False)), "not_owner").when(F.col("private"), "private")
    judged = calls.withColumn("__reason", reason)
    return judged.filter("__reason is null").drop("__reason"), judged.filter("__reason is not null").groupBy(F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))

