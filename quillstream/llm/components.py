"""Connected components of an edge table, without collecting edges or labels.

Alternating large-star and small-star steps: each is a minimum a node (combined
map-side) joined back to the edges, so a hub's neighbours never meet in one list.
Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").selectExpr("v a", "m b").filter("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.selectExpr("greatest(a, b) u", "least(a, b) v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").selectExpr("v a", "m b").filter("a != b")
    return moved.union(least.selectExpr("u a", "m b"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; long): root is the least node reachable.

    Loops and repeated edges are allowed; rows with a null end are dropped. No
    edges give an empty result.
    """
    now = materialise(edges.select("a", "b").filter("a != b").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        done, now = now, materialise(_small_star(_large_star(now)).distinct(), "edges")
        discard(done)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not converge")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.selectExpr("root node", "root").distinct())
