"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Native: DataFrame and SQL functions only.

* Targets: sources by code point (null last) weigh 3, 1, 2, repeating, and share
  ``share`` times all words; a target stops at ``cap`` times its source's words and
  the excess goes to the others by weight (water filling, one row a source).
* Blocks: each source's documents, permuted by a hash, fall into blocks of about
  ``block_rows`` rows. A source takes whole rounds of all its blocks, then a run of
  permuted blocks, then documents of one last block, first fit, until its target.
* Splitting tree: the vector of block quotas of the sources is the root. Every node
  splits its vector in two: an urn draw without replacement, block by block (a fold
  in SQL), which is the multivariate hypergeometric law, decides how many blocks of
  each source go left. Leaves are output shards; the quotas are exact at every node.
* A shard's quota of a source is a run of that source's permuted blocks, disjoint from
  the others'; rows are ordered by a hash inside their shard.

All draws are hashes of fixed names, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A source has 2 ** BLOCK_BITS blocks at most, which bounds the urn whatever the rows.
BLOCK_BITS = 11
#: Tables of a row (or a block) for each source are broadcast for so many sources at most.
FEW = 1000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes (source, words, n): with weight and target. One row a source."""
    w, share, cap = ", ".join(f"{float(x)!r}D" for x in weights), f"{float(share)!r}D", f"{float(cap)!r}D"
    ranked = sizes.selectExpr("*", f"element_at(array({w}), cast(pmod(row_number() over (order by source asc nulls last) - 1, {len(weights)}) + 1 as int)) as weight")
    sums = ranked.selectExpr(
        "*",
        f"{share} * sum(words) over () as whole",
        f"{cap} * words / weight as ratio",
    ).selectExpr(
        "*",
        f"coalesce(sum({cap} * words) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_words",
        "sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as left_weight",
    )
    # the level of the first source that isn't capped; if all are, every target is its cap
    level = "min(case when (whole - full_words) / left_weight <= ratio then struct(ratio, (whole - full_words) / left_weight as level) end) over ()"
    return sums.withColumn("__level", F.expr(f"{level}.level")).withColumn(
        "target", F.expr(f"case when __level is null then {cap} * words else least({cap} * words, __level * weight) end")
    ).select("source", "words", "n", "target")


def _tree(spark: SparkSession, quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """quotas (one row: q array<struct<no, k>>) -> (node from 0, q) of each leaf."""
    depth = max(0, (shards - 1).bit_length())
    if 1 << depth != shards:
        raise ValueError("shards must be a power of two")
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "q")
    for _ in range(depth):
        # block i of a source goes left with the share that the left half still wants of the urn
        got = f"""aggregate(if(x.k > 0, sequence(1L, x.k), cast(array() as array<bigint>)), 0L, (g, i) ->
                    g + if(pmod(xxhash64('{seed}', node, x.no, i), 1000000007L) * (acc.rest - i + 1) < (acc.want - g) * 1000000007L, 1L, 0L))"""
        urn = f"""aggregate(q,
                    named_struct('l', cast(array() as array<bigint>), 'rest', n, 'want', (n + pmod(xxhash64('{seed}', node), 2L)) div 2L),
                    (acc, x) -> transform(array({got}), g -> named_struct('l', array_append(acc.l, g), 'rest', acc.rest - x.k, 'want', acc.want - g))[0]).l"""
        nodes = nodes.selectExpr("*", "aggregate(q, 0L, (a, x) -> a + x.k) as n").selectExpr("node", "q", f"{urn} as l")
        side = "transform(q, (x, i) -> named_struct('no', x.no, 'k', {}))"
        nodes = nodes.selectExpr(f"inline(array(named_struct('node', 2 * node, 'q', {side.format('l[i]')}), named_struct('node', 2 * node + 1, 'q', {side.format('x.k - l[i]')})))")
    return nodes.selectExpr(f"cast(node - {shards} as int) as shard", "q")


def mix(docs: DataFrame, shards: int = 8, block_rows: int = 1024, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source", carry: bool = False, **law) -> DataFrame:
    """(key, size, source_size, target, draws): draws is an array of (shard, place), one
    for each time the mix takes the document; place orders a shard's rows. carry: instead
    docs as they are and draws, a column of that name replaced; no row is shuffled for it.

    Null source is a source of its own, last; a null or empty text has size 0 and is
    never drawn. A very long text is drawn or not like any other: it is counted whole, and a
    source may miss its target by its length. An empty table gives no rows. Keys should differ: rows
    with equal keys share their place in the permutation. Other columns are looked at only with carry,
    and pass through then.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")
    # pos is uniform in 62 bits: a source's rows in order of pos are its permutation
    pos = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key).cast("long")), 2)
    own = [F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), words.alias("size"), pos.alias("pos")]
    rows = common.materialise(docs.select(own), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    goal = targets(sizes, **law).selectExpr(
        "*", "row_number() over (order by source asc nulls last) as no",
        "if(words > 0, cast(floor(target / words) as bigint), 0L) as rounds",
        f"cast(greatest(0, ceil(log2(n / {block_rows}))) as int) as bits",
    )
    goal = common.materialise(goal.selectExpr("*", f"least(bits, {BLOCK_BITS}) as block_bits", "target - rounds * words as part"), "targets")  # a row for each source

    most, sources = goal.agg(F.max("bits"), F.count(F.lit(1))).first()
    held = F.broadcast if sources <= FEW else lambda x: x  # beyond, Spark's shuffles and its skew handling

    def with_goal(r: DataFrame, *more: str) -> DataFrame:
        return r.alias("r").join(held(goal.alias("s")), F.expr("r.source <=> s.source")).selectExpr("key", "size", "pos", *more, "s.*").drop("source", "n")

    rows = with_goal(rows)
    # narrow to the last block, by up to BLOCK_BITS bits at once: all before bound is in, the block has rest words to give
    last = goal.selectExpr("no", "part as rest", "0 as depth", "0L as bound")
    for _ in range(max(1, -(-(most or 0) // BLOCK_BITS))):
        inside = rows.join(held(last), "no").filter("depth = 0 or shiftright(pos, 62 - depth) = shiftright(bound, 62 - depth)").withColumn("deep", F.expr(f"least(bits, depth + {BLOCK_BITS})"))
        sums = inside.selectExpr("no", "rest", "size", "deep", "if(deep = 0, 0L, shiftleft(shiftright(pos, 62 - deep), 62 - deep)) as start").groupBy("no", "rest", "deep", "start").agg(F.sum("size").alias("w"))
        run = sums.selectExpr("*", "sum(w) over (partition by no order by start) as upto")
        found = (
            run.groupBy("no", "rest", "deep").agg(F.min(F.expr("if(upto > rest, struct(start, upto - w as before), null)")).alias("x"))
            .selectExpr("no", "coalesce(rest - x.before, 0D) as rest", "if(x is null, 62, deep) as depth", "coalesce(x.start, 4611686018427387903L) as bound")
        )
        # a source without a last block (depth 62, no row inside) stays as it is in later rounds
        last = common.materialise(last.alias("a").join(found.alias("b"), "no", "left").selectExpr("no", *[f"coalesce(b.{c}, a.{c}) as {c}" for c in ("rest", "depth", "bound")]), "last")
    # its documents first fit in order of pos, by a fold over about block_rows of them
    fits = (
        rows.join(held(last), "no").filter("size > 0 and depth < 62 and (depth = 0 or shiftright(pos, 62 - depth) = shiftright(bound, 62 - depth))")
        .groupBy("no", "rest").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "size"))).alias("d"))
        .selectExpr("no", "aggregate(d, named_struct('rest', rest, 'keys', cast(array() as array<bigint>)), (a, x) -> if(x.size <= a.rest, named_struct('rest', a.rest - x.size, 'keys', array_append(a.keys, x.key)), a)).keys as keys")
        .selectExpr("no", "explode(keys) as key", "true as fits").distinct()
    )
    # quotas in blocks: whole rounds, and blocks of the last round up to the bound
    count = "cast(rounds * shiftleft(1, block_bits) + if(part > 0, 1 + if(block_bits = 0, 0L, shiftright(bound, 62 - block_bits)), 0) as bigint)"
    quotas = goal.join(last, "no").agg(F.expr(f"sort_array(collect_list(named_struct('no', no, 'k', {count})))").alias("q"))
    leaves = common.materialise(_tree(spark, quotas, shards, seed).selectExpr("shard", "inline(q)"), "quotas")
    ends = leaves.selectExpr("no", "shard", "sum(k) over (partition by no order by shard) as upto").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    kept = [c for c in docs.columns if c != "draws"]
    if carry:
        rows = with_goal(docs.select(F.struct(*kept).alias("doc"), *own), "doc")
    out = (
        rows.join(held(last.drop("rest")), "no").join(held(ends), "no").join(held(fits), ["no", "key"], "left")
        .selectExpr("*", "if(size > 0, rounds + if(part > 0 and pos < bound or coalesce(fits, false), 1, 0), 0L) as times", "if(block_bits = 0, 0L, shiftright(pos, 62 - block_bits)) as block")
    )
    draws = f"""transform(if(times > 0, sequence(0L, times - 1L), cast(array() as array<bigint>)), i -> named_struct(
                'shard', filter(ends, e -> e.upto > i * shiftleft(1L, block_bits) + block)[0].shard,
                'place', xxhash64('{seed}', 'place', key, i)))"""
    if carry:
        return out.selectExpr("doc", f"{draws} as draws").select(*[F.col("doc")[c].alias(c) for c in kept], "draws")
    return out.selectExpr(f"key as `{key}`", "size", "words as source_size", "target", f"{draws} as draws")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"))


QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLE: dict[str, str] = {}
