"""Ranks, quotas and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CLUSTER_CAP, PER_FEED, PER_RUN, STORY_CAP


def top_per_key(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key. Partial ranks before the shuffle keep hot keys small."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def feed_caps(items: DataFrame, per_feed: int = PER_FEED, per_run: int = PER_RUN) -> DataFrame:
    """The freshest items of each feed, then of all."""
    fresh = [F.col("minutes_ago").asc_nulls_last(), F.col("seq")]
    return top_per_key(items, ["feed_id"], fresh, per_feed).orderBy(*fresh).limit(per_run)


def global_rank(rows: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of all, ranked: a top-k, then a rank of what is left."""
    return rows.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def quota_top(rows: DataFrame, order: list[Column], cap: int = CLUSTER_CAP, social: str = "kind = 'social'") -> DataFrame:
    """At most ``cap`` rows by rank, of which the best 2 or 3 social ones have their places.

    Only rows that can matter are ranked: the first ``cap`` of either side.
    """
    quota = 2 if cap <= 10 else 3
    best = rows.filter(social).orderBy(*order).limit(quota).withColumn("reserved", F.lit(True))
    few = rows.orderBy(*order).limit(cap + quota).join(best.select("seq", "reserved"), "seq", "left")
    n = best.agg(F.count("*").alias("_n"))
    rest = few.filter("reserved is null").crossJoin(F.broadcast(n))
    filled = rest.withColumn("_r", F.row_number().over(Window.orderBy(*order))).filter(F.col("_r") <= F.lit(cap) - F.col("_n")).drop("_r", "_n")
    return best.unionByName(filled.select(*rows.columns, "reserved")).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def overflow_cap(stories: DataFrame, by: list[str], order: list[Column], on_beat: Column, cap: int = STORY_CAP) -> DataFrame:
    """Beyond ``cap`` stories a key: off-beat ones go if any is on beat, then the best ``cap`` stay. Up to ``cap``, all stay."""
    own = Window.partitionBy(*by)
    flagged = stories.withColumn("_n", F.count("*").over(own)).withColumn("_beat", on_beat).withColumn("_any", F.max("_beat").over(own))
    able = flagged.filter("_n <= %d or not _any or _beat" % cap)
    ranked = able.withColumn("_rank", F.row_number().over(own.orderBy(*order)))
    return ranked.filter(f"_n <= {cap} or _rank <= {cap}").drop("_n", "_beat", "_any", "_rank")
