"""Streams of items and events: first sightings, windowed counts, and the newest row of each key as a table.

Sources replay and executors can be lost: every sink here writes a batch under its
id, so that a batch done again replaces itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only under a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="streams-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in a new shared folder, reread: later steps neither work them out again nor carry their expressions."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def first_sightings(stream: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """Each key once within ``late``; the state of older keys goes with the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, by: list[str], at: str, every: str, late: str) -> DataFrame:
    """(start, *by, n) of windows of ``every``; rows later than ``late`` are not counted."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), *by, "n")


def newest_into(path: str, by: list[str], order: list[Column]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the newest row of each key of a batch, written to the batch's own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ranking.top_per_key(batch, by, order, 1).drop("rank").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def newest(spark: SparkSession, path: str, by: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key over all batches written so far; of equals that of the later batch."""
    return ranking.top_per_key(spark.read.parquet(path), by, [*order, F.col("batch").desc()], 1).drop("rank", "batch")


def run_once(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes all that has arrived, in batches, and ends."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def appended_into(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows of a batch, written to the batch's own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
