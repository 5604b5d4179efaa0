"""Sharding by a k-d tree over metadata, with DataFrame functions only.

A node of the tree that is to give k shards is split along its widest dimension,
at the place that leaves k div 2 shards' share of its bytes on one side: a
weighted median where k is even. The halves are split in the same way until every
leaf is one shard, so all leaves reach the same target: the bytes of all
documents, divided by the number of shards, but for one document a level.

Dimensions: numbers, scaled to the table's range (sizes by their logarithm), and
names, placed by their hash, so that equal names lie together. Each row's key in
a dimension is its place there and a hash of its own in the low bits; so a name,
or equal rows, that hold most bytes are split like any others.

The medians are distributed: each round sums the bytes of 1,024 equal slices of
every open node's key range (map-side), and looks closer at the slice that holds
the median, until that slice is one row or a thousandth of a shard. All nodes of
a level share the rounds. What reaches the driver is one row a node and round;
the tree itself is an expression of at most shards - 1 comparisons. Rows of
metadata are written once and scanned by each round; texts are read once and
never shuffled. Slots come from one range sort.

Null texts count as empty (size 8), null names as the empty name, null numbers as
the smallest. Repeated rows are rows of their own. An empty table gives an empty
result; with few or very unequal documents some shards may be empty. Other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .packing import numbered

#: Bits of a key: its place in the dimension, and the row's own hash below.
PLACE, OWN = 30, 32
#: Slices of a key range that one round sums.
SLICES = 1024
#: A slice of less than this share of a shard's bytes is not looked into.
CLOSE = 1 / 1000


@dataclass
class Node:
    """Of the tree: how many shards it is to give, the first of them, and where it is split."""

    shards: int
    first: int
    axis: int | None = None
    cut: int | None = None  # keys below go to ``low``
    low: Node | None = None
    high: Node | None = None


def _scaled(value: Column, least: float | None, most: float | None) -> Column:
    if least is None or not most > least:
        return F.lit(0).cast("long")
    share = (value - F.lit(least)) / F.lit(most - least)
    return F.coalesce((F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(float((1 << PLACE) - 1))).cast("long"), F.lit(0).cast("long"))


def metadata(docs: DataFrame, names: tuple[str, ...], numbers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """A written table of what sharding needs, and over it doc_id, size, text_crc32, row, and a key k0, k1, ... in each dimension: the size, then numbers, then names."""
    written = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.expr("octet_length(coalesce(text, '')) + 8L").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            *(F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(numbers)),
            *(F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), 64 - PLACE).alias(f"h{i}") for i, c in enumerate(names)),
            F.monotonically_increasing_id().alias("row"),
        ),
        "metadata",
    )
    values = [F.log(F.col("size").cast("double")), *(F.col(f"v{i}") for i in range(len(numbers)))]
    bounds = written.agg(*(f(v) for v in values for f in (F.min, F.max))).first()
    places = [_scaled(v, bounds[2 * i], bounds[2 * i + 1]) for i, v in enumerate(values)] + [F.col(f"h{i}") for i in range(len(names))]
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "row"), 64 - OWN)
    return written, written.select("doc_id", "size", "text_crc32", "row", *(F.shiftleft(p, OWN).bitwiseOR(own).alias(f"k{i}") for i, p in enumerate(places)))


def place_in(tree: Node, value) -> Column:
    """An expression that follows the tree to a leaf and gives ``value(leaf)``, a column, there."""
    if tree.low is None:
        return value(tree)
    return F.when(F.col(f"k{tree.axis}") < F.lit(tree.cut), place_in(tree.low, value)).otherwise(place_in(tree.high, value))


def _at_leaf(rows: DataFrame, keep: list[str], tree: Node, value) -> DataFrame:
    """Columns ``keep`` and the fields of ``value(leaf)``, a struct; rows of leaves for which it is None are left out.

    The tree is followed once a row: inline() keeps Spark from repeating it for each field.
    """
    known = next(v for v in map(value, _leaves(tree)) if v is not None)
    none = F.when(F.lit(False), known)
    found = place_in(tree, lambda leaf: none if (v := value(leaf)) is None else v)
    return rows.select(*keep, F.inline(F.filter(F.array(found), lambda x: x.isNotNull())))


def _leaves(tree: Node) -> list[Node]:
    return [tree] if tree.low is None else _leaves(tree.low) + _leaves(tree.high)


def _medians(rows: DataFrame, tree: Node, ranges: dict[int, tuple[int, int, int]], targets: dict[int, float], close: float) -> dict[int, int]:
    """Of each open leaf the key that leaves ``targets`` bytes below it; ranges: of each its axis, and the least and last key.

    Each round narrows every leaf's range to the slice that holds the target.
    """
    cuts: dict[int, int] = {}
    below = dict.fromkeys(ranges, 0)
    left = dict(ranges)
    while left:
        width = {k: -(-(last - least + 1) // SLICES) for k, (_, least, last) in left.items()}

        def slice_of(leaf: Node, left=left, width=width, below=below) -> Column | None:
            if leaf.low is not None or leaf.first not in left:
                return None
            axis, least, last = left[leaf.first]
            place = F.expr(f"if(k{axis} between {least}L and {last}L, (k{axis} - {least}L) div {width[leaf.first]}L, null)")
            return F.struct(F.lit(leaf.first).alias("node"), place.alias("slice"), F.col(f"k{axis}").alias("key"), F.lit(float(targets[leaf.first] - below[leaf.first])).alias("goal"))

        sliced = _at_leaf(rows, ["size"], tree, slice_of).filter("slice is not null")
        summed = sliced.groupBy("node", "goal", "slice").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("last"))
        ran = summed.withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("slice")))  # SLICES rows a node at most
        hit = ran.filter("upto >= goal").groupBy("node").agg(F.min(F.struct("slice", "bytes", "n", "upto", "least", "last")).alias("at"))
        for node, at in hit.collect():
            axis = left.pop(node)[0]
            under = below[node] + at["upto"] - at["bytes"]
            if at["n"] > 1 and at["bytes"] > close and at["last"] > at["least"]:
                left[node], below[node] = (axis, at["least"], at["last"]), under
            else:  # at the nearer edge of the slice
                cuts[node] = at["least"] if targets[node] - under <= under + at["bytes"] - targets[node] else at["last"] + 1
    return cuts


def grow(rows: DataFrame, axes: int, shards: int) -> Node:
    """The tree over the rows of ``metadata``."""
    tree = Node(shards, 0)
    while open_ := {leaf.first: leaf for leaf in _leaves(tree) if leaf.shards > 1}:
        keys = [f"k{i}" for i in range(axes)]
        placed = _at_leaf(rows, ["size", *keys], tree, lambda leaf, open_=open_: F.struct(F.lit(leaf.first).alias("node")) if leaf.first in open_ else None)
        spans = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max))).collect()
        ranges, targets, close = {}, {}, 0.0
        for r in spans:
            axis = max(range(axes), key=lambda i: ((r[f"max_k{i}"] >> OWN) - (r[f"min_k{i}"] >> OWN), -i))
            leaf = open_[r["node"]]
            ranges[r["node"]] = (axis, r[f"min_k{axis}"], r[f"max_k{axis}"])
            targets[r["node"]] = r["bytes"] * (leaf.shards // 2) / leaf.shards
            close = max(close, r["bytes"] / leaf.shards * CLOSE)
        cuts = _medians(rows, tree, ranges, targets, close) if ranges else {}
        for first, leaf in open_.items():
            half = leaf.shards // 2
            leaf.axis, leaf.cut = (ranges[first][0], cuts[first]) if first in cuts else (0, 0)  # a leaf without rows: its shards stay empty
            leaf.low, leaf.high = Node(half, first), Node(leaf.shards - half, first + half)
    return tree


def kd_shards(docs: DataFrame, shards: int = 24, names: tuple[str, ...] = ("source", "lang"), numbers: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: doc_id, size (bytes of the text and 8), text_crc32, law (``bytes``), shard, slot in it, grown_shard (null)."""
    written, rows = metadata(docs, names, numbers)
    tree = grow(rows, 1 + len(numbers) + len(names), shards)
    placed = _at_leaf(rows, ["doc_id", "size", "text_crc32", "row"], tree, lambda leaf: F.struct(F.lit(leaf.first).cast("int").alias("shard")))
    out = numbered(placed, ["shard", "doc_id", "row"], "slots", at="at")
    discard(written)
    starts = out.groupBy("shard").agg(F.min("at").alias("start"))  # one row a shard
    return out.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
