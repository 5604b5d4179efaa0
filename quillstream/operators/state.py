"""Incremental state: upserts, expiry, holds, retention, keepers and net-new sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows with ``is_current``: the newest of each key, the others demoted."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("is_current", n == 1)


def upsert(state: DataFrame, changes: DataFrame, by: list[str], order: str) -> DataFrame:
    """The state after the changes: of each key the row of the greatest ``order``, changes first among equals."""
    both = state.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    best = both.groupBy(*by).agg(F.max_by(F.struct(*state.columns), F.struct(order, "_new")).alias("r"))
    return best.select("r.*")


def unexpired(rows: DataFrame, as_of: Column, keep_edge: bool = False) -> DataFrame:
    """Rows that are still alive (strictly, or with the last instant)."""
    return rows.filter(F.col("expires_at") >= as_of if keep_edge else F.col("expires_at") > as_of)


def carried_over(current: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """The current rows and those held before that are not among them."""
    return current.unionByName(held.join(current.select(by), by, "left_anti").select(*current.columns))


def insert_absent(state: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The state with the new rows whose key it lacks."""
    return state.unionByName(new.join(state.select(*by), by, "left_anti").dropDuplicates(by).select(*state.columns))


def deactivated(mapping: DataFrame, manifest: DataFrame, by: str) -> DataFrame:
    """The mapping with rows inactive that the manifest no longer has."""
    there = manifest.select(by).distinct().withColumn("_there", F.lit(True))
    return mapping.join(there, by, "left").withColumn("active", F.col("active") & F.col("_there").isNotNull()).drop("_there")


def net_new(events: DataFrame, known: DataFrame, raw: str, kind: str, user: str, at: str, since: Column) -> DataFrame:
    """Names seen since then that no known alias resolves: first and last seen, times, first three users.

    A user is one row of a name first, so that three of them are kept by rank and no name's users are gathered.
    """
    recent = events.filter(F.col(at) >= since).join(known, raw, "left_anti")
    per_user = recent.groupBy(raw, kind, F.col(user).cast("string").alias("_user")).agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.count("*").alias("_n"))
    ranked = per_user.withColumn("_r", F.row_number().over(Window.partitionBy(raw, kind).orderBy("_user")))
    users = F.array_join(F.array_sort(F.collect_list(F.when((F.col("_r") <= 3) & F.col("_user").isNotNull(), F.col("_user")))), ",")
    return ranked.groupBy(raw, kind).agg(F.min("_a").alias("first_seen"), F.max("_b").alias("last_seen"), F.sum("_n").alias("times_seen"), users.alias("users"))
