"""K-d tree sharding: split at distributed weighted medians along the widest dimension.

Rows of one group (equal texts) stay together, so the points of the tree are the groups:
a partially aggregated ``groupBy`` gives each its bytes as weight and, of each dimension, its
least value. All nodes of a level are split together. A node's candidate cut along a
dimension is its weighted median on a 62-bit position: the dimension's value scaled to the
node's own range (upper half), and a hash of the group (lower half), by which equal values
are told apart and nothing else. The median is found by histogram descent: per round one
partially aggregated ``groupBy(node, dimension, bin)`` narrows every node's interval 4096
times. The widest dimension (range against the range of the root) whose cut is balanced
within ``tolerance`` wins, else the best balanced one.

The points and their nodes are written to the shared folder level by level, so no plan is
longer than one level. Only the tree is on the driver: two nodes a leaf, and leaves number
total bytes / target bytes, whatever the rows are. Rows find their point's leaf by a
join on the group; groups of more than one row in ``FREQUENT`` (``FREQUENT`` of them at most)
are broadcast for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BINS_LOG2, HASH_BITS, FREQUENT = 12, 31, 512


def _position(value: Column, lo: Column, hi: Column, tie: Column) -> Column:
    """A long from 0 to 2**62 - 1 that orders by value between lo and hi, then by tie."""
    scaled = F.when(hi > lo, F.floor((value - lo) / (hi - lo) * float((1 << 31) - 1))).otherwise(F.lit(0)).cast("long")
    return F.shiftleft(scaled, HASH_BITS) + tie


class _Tree:
    """Points and the node each of them is in, level after level."""

    def __init__(self, points: DataFrame, n: int):
        """points: tie, weight, rows, p0 to p(n - 1)."""
        self.n, self.spark = n, points.sparkSession
        self.points = common.materialise(points.withColumn("node", F.lit(1).cast("long")), "points")

    def nodes(self, least: int) -> list[dict]:
        """Weight and ranges of each node from number least on: a row for each node."""
        bounds = [f(f"p{k}") for k in range(self.n) for f in (F.min, F.max)]
        got = self.points.filter(F.col("node") >= least).groupBy("node").agg(F.sum("weight"), *bounds).collect()
        return [{"node": r[0], "weight": r[1], "range": [(r[2 + 2 * k], r[3 + 2 * k]) for k in range(self.n)]} for r in got]

    def medians(self, nodes: list[dict], tolerance: float) -> dict:
        """(node, dim) -> (cut, weight below it): a position below cut goes left."""
        dims = range(self.n)
        ranges = self.spark.createDataFrame([(x["node"], k, *x["range"][k]) for x in nodes for k in dims], "node long, k int, lo double, hi double")
        each = self.points.select("node", "weight", "tie", F.posexplode(F.array(*[f"p{k}" for k in dims])).alias("k", "v")).join(F.broadcast(ranges), ["node", "k"])
        places = each.select("node", "k", "weight", _position(F.col("v"), F.col("lo"), F.col("hi"), F.col("tie")).alias("pos"))
        total = {x["node"]: x["weight"] for x in nodes}
        #: (node, dim) -> start of the interval that holds the median, weight before it
        open_, done = {(n, k): (0, 0) for n in total for k in dims}, {}
        shift = 62 - BINS_LOG2
        while open_:
            at = F.broadcast(self.spark.createDataFrame([(n, k, lo, total[n] / 2 - b) for (n, k), (lo, b) in open_.items()], "node long, k int, start long, half double"))
            bins = (
                places.join(at, ["node", "k"])
                .withColumn("bin", F.shiftright(F.col("pos") - F.col("start"), shift))
                .filter(f"bin between 0 and {(1 << BINS_LOG2) - 1}")
                .groupBy("node", "k", "half", "bin").agg(F.sum("weight").alias("w"))
                .selectExpr("*", "sum(w) over (partition by node, k order by bin) as upto")
            )
            found = bins.filter("upto >= half").groupBy("node", "k").agg(F.min(F.struct("bin", "upto", "w")).alias("x")).select("node", "k", "x.*").collect()
            again = {}
            for n, k, bin_, upto, w in found:
                start, before = open_[n, k]
                lo, below, above, half = start + (bin_ << shift), before + upto - w, before + upto, total[n] / 2
                if shift == 0 or w <= tolerance * total[n] / 4:
                    done[n, k] = (lo, below) if half - below < above - half else (lo + (1 << shift), above)
                else:
                    again[n, k] = (lo, below)
            open_, shift = again, max(0, shift - BINS_LOG2)
        return done

    def split(self, splits: list[tuple]) -> None:
        """splits: (node, dim, lo, hi, cut)."""
        table = F.broadcast(self.spark.createDataFrame(splits, "node long, k int, lo double, hi double, cut long"))
        value = F.element_at(F.array(*[f"p{k}" for k in range(self.n)]), F.col("k") + 1)
        left = _position(value, F.col("lo"), F.col("hi"), F.col("tie")) < F.col("cut")
        node = F.when(F.col("k").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 0).otherwise(1))
        old, columns = self.points, self.points.columns
        self.points = common.materialise(old.join(table, "node", "left").withColumn("node", node).select(columns), "points")
        common.discard(old)


def ordinal(column: str) -> Column:
    """Strings as numbers in the order of their first six bytes; null comes first."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(f"`{column}`"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


def kd_shards(df: DataFrame, dims: list[str], weight: str, group: str, leaves: int | None = None, target_bytes: int | None = None, tolerance: float = 0.01) -> DataFrame:
    """df with a ``shard`` int for each row, from 0.

    dims: numeric columns (null counts as -1); weight: a long column (null counts as 0); group: a
    long column, a hash: rows equal in it stay together (null is a group too), and the
    group's place along a dimension is the least of its rows. Give leaves (a power of two), or
    target_bytes: a node splits until it weighs that at most. A group is never divided, so with
    very large groups shards differ by as much as half of one, and some may be missing. An empty
    table gives no rows. Columns pass through, whatever their names, but for one called
    shard, which is replaced. df is read twice and should be materialised.
    """
    spark, df = df.sparkSession, df.drop("shard")
    point = F.xxhash64(F.col(f"`{group}`"))
    places = [F.min(F.coalesce(F.col(f"`{d}`").cast("double"), F.lit(-1.0))).alias(f"p{k}") for k, d in enumerate(dims)]
    points = df.groupBy(point.alias("point")).agg(F.sum(F.coalesce(F.col(f"`{weight}`"), F.lit(0)).cast("long")).alias("weight"), F.count(F.lit(1)).alias("rows"), *places)
    tree = _Tree(points.withColumn("tie", F.pmod("point", F.lit(1 << HASH_BITS))), len(dims))
    level = root = tree.nodes(1)
    wide = [(hi - lo) or 1.0 for lo, hi in root[0]["range"]] if root else []
    depth, ends = 0, set()
    while level:
        big = [x for x in level if (1 << depth < leaves if leaves else x["weight"] > target_bytes) and x["weight"] > 0]
        cuts = tree.medians(big, tolerance) if big else {}
        splits = []
        for x in big:

            def rank(k: int, x: dict = x) -> tuple:
                off = abs(cuts[x["node"], k][1] / x["weight"] - 0.5)
                lo, hi = x["range"][k]
                return (off if off > tolerance else 0, -(hi - lo) / wide[k], k)

            k = min(range(len(dims)), key=rank)
            cut, w = cuts[x["node"], k]
            if 0 < w < x["weight"]:
                splits.append((x["node"], k, *x["range"][k], cut))
        ends |= {x["node"] for x in level} - {x[0] for x in splits}
        depth += 1
        if splits:
            tree.split(splits)
        level = tree.nodes(1 << depth) if splits else []
    number = spark.createDataFrame([(n, i) for i, n in enumerate(sorted(ends))], "node long, shard int")
    placed = tree.points.join(F.broadcast(number), "node").select("point", "shard", "rows")
    rows = df.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in df.columns]).alias("row"), point.alias("point"))
    total = tree.points.agg(F.sum("rows")).first()[0] or 0
    heavy = F.broadcast(placed.filter(F.col("rows") * FREQUENT >= total).select("point", F.col("shard").alias("hot")))
    split = rows.join(heavy, "point", "left")
    cold = split.filter("hot is null").drop("hot").join(placed.select("point", "shard"), "point")
    out = split.filter("hot is not null").select("row", "point", F.col("hot").alias("shard")).unionByName(cold.select("row", "point", "shard"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns], "shard")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes; equal texts share a shard. The
    dimensions are metadata: id, language, source and length."""
    whole = F.coalesce("text", F.lit(""))
    rows = common.table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
        ordinal("lang").alias("lang"), ordinal("source").alias("source"), F.length(whole).alias("chars"), F.xxhash64(whole).alias("digest"),
    )
    rows = common.materialise(rows, "rows")
    placed = common.materialise(kd_shards(rows, ["doc_id", "lang", "source", "chars"], "size", "digest", leaves=8), "placed")
    return common.numbered(placed, ["shard"], "doc_id", "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_kd_shards": op1_kd_shards}
ORACLE: dict[str, str] = {}
