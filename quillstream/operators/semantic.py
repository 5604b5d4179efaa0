"""Semantic scores of items against readers' profiles, with vectors kept by content."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import trimmed
from ..sources.store import VersionedTables
from .ranking import top_per_key

VECTORS = "vectors"
#: Profiles of which one block is broadcast.
PROFILES = 2048


def _clean(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def intent_text(topics: Column, keywords: Column, geographies: Column, narrative: Column) -> Column:
    """What a reader looks for, in sentences: the narrative first, then each list that is not empty."""
    parts = [F.when(trimmed(narrative) != "", F.concat(F.lit("Beat narrative: "), trimmed(narrative)))]
    for values, lead in ((topics, "I monitor news about "), (keywords, "Specific topics I care about: "), (geographies, "Geographic focus: ")):
        own = _clean(values)
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit(lead), F.array_join(own, ", "), F.lit("."))))
    return F.concat_ws(" ", *parts)


def item_text(headline: Column, subtitle: Column, body: Column, most: int = fixed.ITEM_CHARS) -> Column:
    """Headline, subtitle and body (lines) as one text of at most ``most`` characters."""
    return F.substring(_parted(". ", headline, subtitle, _lines(body)), 1, most)


def recall_text(outlet: Column, headline: Column, body: Column) -> Column:
    """Outlet, headline and body (lines), parted by dashes."""
    return _parted(" — ", outlet, headline, _lines(body))


def _lines(body: Column) -> Column:
    return F.array_join(F.coalesce(body, F.array().cast("array<string>")), " ")


def _parted(mark: str, *texts: Column) -> Column:
    """Those of the texts, trimmed, that are not null or empty."""
    return F.array_join(F.filter(F.array(*map(trimmed, texts)), lambda x: x != ""), mark)


def profile_key(topics: Column, keywords: Column, geographies: Column, narrative: Column, model: str) -> Column:
    """A name for what a profile says, whatever the order and case of its lists."""
    lists = {n: F.array_sort(F.transform(_clean(c), F.lower)) for n, c in (("topics", topics), ("keywords", keywords), ("geographies", geographies))}
    return F.sha1(F.to_json(F.struct(*(c.alias(n) for n, c in lists.items()), F.coalesce(trimmed(narrative), F.lit("")).alias("narrative"), F.lit(model).alias("model"))))


def text_key(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}\n"), text), 256)


def embedded(cache: VersionedTables, rows: DataFrame, text: str, embed: Callable[[Column], Column], model: str) -> tuple[DataFrame, int]:
    """Rows with ``vector`` of their texts (null where there is none), and how many texts had to be embedded.

    cache: a store with a table ``vectors`` by ``key``. Each different text is
    embedded once, and never again by a later call: what is known is found by the
    hash of the text and the model.
    """
    keyed = rows.withColumn("_key", F.when(F.col(text) != "", text_key(F.col(text), model)))
    wanted = keyed.filter("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.min(text).alias("text"))
    known = cache.read(VECTORS)
    misses = wanted if known is None else wanted.join(known, "key", "left_anti")
    n = misses.count()
    if n:
        cache.commit({VECTORS: misses.select("key", embed(F.col("text")).alias("vector"))})
    vectors = cache.read(VECTORS)
    if vectors is None:
        return keyed.withColumn("vector", F.lit(None).cast("array<double>")).drop("_key"), 0
    return keyed.join(vectors.withColumnRenamed("key", "_key"), "_key", "left").drop("_key"), n


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def nearest(items: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """(reader, item, score, rank): the ``k`` items of each reader with the best scores, (cosine + 1) / 2 to nine places; ties by item.

    items: item (long), vector; profiles: reader (string), vector. Blocks of
    profiles are broadcast as matrices; a batch of items is one matrix product, and
    only its best ``k`` of each reader go on, so what is shuffled is k rows a
    reader and batch. Null vectors take no part.
    """
    spark = items.sparkSession
    able = items.filter("vector is not null").select(F.col("item").cast("long").alias("item"), F.col("vector").cast("array<double>").alias("vector"))
    own = profiles.filter("vector is not null").select(F.col("reader").cast("string").alias("reader"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, math.ceil(1.5 * own.count() / PROFILES))

    def scored(block: int) -> DataFrame:
        rows = own.filter(F.pmod(F.xxhash64("reader"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(([r["reader"] for r in rows], _unit(np.array([r["vector"] for r in rows], np.float64)) if rows else None))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            readers, matrix = shared.value
            for batch in batches:
                if matrix is None or not len(batch):
                    continue
                ids = batch.column(0).to_numpy()
                own_ = _unit(np.array(batch.column(1).to_pylist(), np.float64))
                for at in range(0, len(ids), 1024):
                    score = np.round((np.clip(own_[at : at + 1024] @ matrix.T, -1, 1) + 1) / 2, 9)
                    part = ids[at : at + 1024]
                    order = np.lexsort((np.broadcast_to(part[:, None], score.shape), -score), axis=0)[:k]
                    column = np.broadcast_to(np.arange(len(readers)), order.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(readers).take(pa.array(column.ravel())), pa.array(part[order.ravel()]), pa.array(score[order.ravel(), column.ravel()])], ["reader", "item", "score"])

        return able.mapInArrow(best, "reader string, item long, score double")

    out = scored(0)
    for block in range(1, blocks):
        out = out.unionByName(scored(block))
    return top_per_key(out, ["reader"], [F.col("score").desc(), F.col("item").asc()], k)


def score_buckets(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, n in each fifth of 0..1, mean): the last fifth is closed."""
    fifth = F.least(F.floor(F.col(score) * 5), F.lit(4))
    counts = [F.count_if(fifth == i).alias(f"n{i}") for i in range(5)]
    return rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by).agg(*counts, F.avg(score).alias("mean"))
