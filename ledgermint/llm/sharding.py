"""K-d tree partitioning by distributed weighted medians, with DataFrame functions alone.

A node of the tree is split along its widest metadata dimension, at the place that halves its bytes
(or, for an odd number of leaves below it, divides them in proportion), until each leaf is one
shard. All nodes of a level are split together. The place is found by weighted histograms of a few
hundred buckets, narrowed in rounds; the driver sees at most `shards` x `BUCKETS` sums a round,
whatever the size of the data. A hash makes equal metadata values distinct, so a source or a group
of equal texts that is larger than a shard is split as well.

The tree of the levels above is a handful of literal arrays: a row finds its node by comparing along
one path of it, so that no level joins or shuffles rows, and every job reads the same written table
of a few numbers per row. What is shuffled are the sums.

Null text: 0 bytes. Null metadata has a place apart from any value's. Repeated rows are placed one by
one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

SHARDS = 40
#: Buckets of a histogram, and how often one is narrowed.
BUCKETS, ROUNDS = 1024, 3
#: Rows that one task numbers at most, about.
SLOT_ROWS = 1 << 15
#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def _category(c: Column) -> Column:
    """A place from 0 for each value, by its hash; -1 for null."""
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(1 << 16)), F.lit(-1)).cast("double")


def _of(node: Column, values: list) -> Column:
    """The value of a node, from a literal array of one value per node."""
    return F.get(F.array(*[F.lit(x) for x in values]), node)


class Level:
    """A level of the tree, by node: the dimension it is split along, the cut, and the nodes below it in the next level. A leaf is not split."""

    def __init__(self):
        self.dims, self.cuts, self.left, self.right = [], [], [], []

    def next_node(self, node: Column, key) -> Column:
        return F.when(key(_of(node, self.dims)) >= _of(node, self.cuts), _of(node, self.right)).otherwise(_of(node, self.left))


def _narrowed(found: list, histogram: list[tuple[int, float]]) -> None:
    """Narrows a search [dim, low, high, bytes below low, target, cut] to the bucket in which the target is reached; the cut is its nearer end."""
    _, low, high, before, target, _ = found
    step, total = (high - low) / BUCKETS, before
    for b, w in sorted(histogram):
        if total + w >= target:
            a, z = low + b * step, high if b == BUCKETS - 1 else low + (b + 1) * step
            found[1:4], found[5] = [a, z, total], a if target - total < total + w - target else z
            return
        total += w


def kd_shards(rows: DataFrame, size_col: str, dims: list[str], tie_col: str, shards: int = SHARDS) -> DataFrame:
    """`rows`, which are materialised, with the column `shard`, 0 to `shards` - 1.

    `dims` hold whole numbers as doubles, and `tie_col` numbers in [0, 1) that tell equal values
    apart. Nothing of the rows reaches the driver but the bounds and histograms of the nodes.
    """
    key = lambda dim: F.get(F.array(*dims), dim) + F.col(tie_col)
    spans: list[float] = []
    levels: list[Level] = []
    leaves = [shards]  # of each node of the level that is being split
    while any(n > 1 for n in leaves):
        placed = rows.withColumn("_node", F.lit(0))
        for level in levels:
            placed = placed.withColumn("_node", level.next_node(F.col("_node"), key))
        ends = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
        found = {r["_node"]: r for r in placed.groupBy("_node").agg(F.sum(size_col).alias("bytes"), *ends).collect()}
        width = lambda r: [r[f"max_{d}"] - r[f"min_{d}"] for d in dims]
        spans = spans or [max(w, 1.0) for w in width(found[0])] if found else [1.0] * len(dims)
        search: dict[int, list] = {}
        for k, n in enumerate(leaves):
            if n > 1 and k in found:
                r = found[k]
                dim = max(range(len(dims)), key=lambda i: width(r)[i] / spans[i])  # noqa: B023
                search[k] = [dim, r[f"min_{dims[dim]}"], r[f"max_{dims[dim]}"] + 1.0, 0, r["bytes"] * (n // 2) / n, 0.0]
        for _ in range(ROUNDS if search else 0):
            low, high, dim = ([float(search[k][i]) if k in search else 0.0 for k in range(len(leaves))] for i in (1, 2, 0))
            node = F.col("_node")
            place = (key(_of(node, [int(x) for x in dim])) - _of(node, low)) / _of(node, [max(z - a, 1e-300) for a, z in zip(low, high, strict=True)]) * BUCKETS
            # no filter on `_node` or `_at`: it would be pushed down, and the path of the tree with it, once for each of its uses
            searched = placed.select("_node", size_col, place.alias("_at")).withColumn("b", F.when((F.col("_at") >= 0) & (F.col("_at") < BUCKETS), F.floor("_at").cast("int")))
            sums: dict[int, list] = {}
            for r in searched.groupBy("_node", "b").agg(F.sum(size_col).alias("bytes")).collect():
                if r["b"] is not None:
                    sums.setdefault(r["_node"], []).append((r["b"], r["bytes"]))
            for k, s in search.items():
                _narrowed(s, sums.get(k, []))
        level, below = Level(), []
        for k, n in enumerate(leaves):
            dim, *_, cut = search.get(k, [0, 0.0])
            level.dims.append(dim)
            level.cuts.append(float(cut))
            level.left.append(len(below))
            below.append(n if n == 1 else n // 2)
            level.right.append(len(below) if n > 1 else len(below) - 1)
            below += [n - n // 2] if n > 1 else []
        levels.append(level)
        leaves = below
    shard = F.lit(0)  # every node is a leaf, and these stand in order
    for level in levels:
        rows = rows.withColumn("shard", level.next_node(shard, key))
        shard = F.col("shard")
    return rows if levels else rows.withColumn("shard", F.lit(0))


def gapless(rows: DataFrame, group: str, tie_col: str, order: list[str], n_rows: int, groups: int) -> DataFrame:
    """`rows` with `slot`, gapless from 0 in each group; a large group is numbered by many tasks."""
    parts = max(1, -(-n_rows // (groups * SLOT_ROWS)))
    dealt = rows.withColumn("_part", F.floor(F.col(tie_col) * parts).cast("int"))
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("n"))  # groups x parts rows
    before = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("n").over(Window.partitionBy(group).orderBy("_part")) - F.col("n")).alias("_before"))
    numbered = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    joined = numbered.join(before, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_part", "_g", "_p", "_before", "_rank")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards of near equal bytes by a k-d tree over size and `categories`."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = (F.length(raw) + ROW_BYTES).cast("long")
    meta = docs.select(F.col(id_col), size.alias("size"), F.crc32(raw).alias("text_crc32"), *[_category(F.col(c)).alias(f"_d{i}") for i, c in enumerate(categories)], F.monotonically_increasing_id().alias("_row"))
    tie = F.shiftrightunsigned(F.xxhash64(id_col, "text_crc32", "_row"), 34) / F.lit(float(1 << 30))
    meta = materialise(meta.select("*", F.col("size").cast("double").alias("_size"), tie.alias("_tie")))
    placed = kd_shards(meta, "size", ["_size", *[f"_d{i}" for i in range(len(categories))]], "_tie", shards)
    placed = materialise(placed.select(id_col, "size", "text_crc32", "shard", "_tie", "_row"))
    return gapless(placed, "shard", "_tie", ["_tie", id_col, "_row"], meta.count(), shards).select(id_col, "size", "text_crc32", "shard", "slot")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """All `documents` in 40 shards of near equal bytes."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
