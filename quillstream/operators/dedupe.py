"""Cross-feed dedupe: merge keys, anchored time windows and winners."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import WINDOW_MINUTES
from ..functions.text import canonical_url, host_of, live_subject, normalized_headline, source_identity


def richness(body: Column, headline: Column, byline: Column | None = None) -> Column:
    """How much evidence an item carries."""
    chars = F.aggregate(F.coalesce(body, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.length(x), F.lit(0)))
    signed = F.when(F.coalesce(F.trim(byline), F.lit("")) != "", 50).otherwise(0) if byline is not None else F.lit(0)
    return 2 * chars + F.coalesce(F.length(headline), F.lit(0)) + signed


def finite(c: Column) -> Column:
    """Null for null, NaN and infinities."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def anchored_windows(rows: DataFrame, by: list[str], time: str, tie: str, minutes: float = WINDOW_MINUTES) -> DataFrame:
    """Rows with ``anchor``, the least time of their window: it opens with a row and holds what is at most ``minutes`` later.

    Windows do not chain: what lies beyond an anchor opens the next one. Each key's
    distinct times pass one task in order, of which it holds the last anchor only;
    the anchors are joined back to the rows by key and time. Rows without a finite
    time stand alone (null anchor).
    """
    keys = [f"_{c}" for c in by]
    timed = rows.withColumn("_t", finite(F.col(time)))
    times = timed.filter("_t is not null").select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col("_t").alias("_at")).distinct()
    ordered = times.repartition(*keys).sortWithinPartitions(*keys, "_at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchor = None, 0.0
        for batch in batches:
            out = []
            for *key, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now or at - anchor > minutes:
                    now, anchor = key, at
                out.append(anchor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*keys, "_at", "_from"])

    shape = T.StructType([*ordered.schema.fields, T.StructField("_from", T.DoubleType())])
    on = [*(F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)), F.col("_t") == F.col("_at")]
    return timed.join(ordered.mapInArrow(fold, shape), on, "left").drop("_t", "_at", *keys).withColumnRenamed("_from", "anchor")


def merge_keys(items: DataFrame) -> DataFrame:
    """Items with the kind and key they merge by: live (publisher, subject), url (with headline), headline, or alone."""
    url = canonical_url(F.col("url")) if "url" in items.columns else F.lit(None).cast("string")
    keyed = items.withColumn("_url", url).withColumn("_head", normalized_headline(F.col("headline"))).withColumn("_live", live_subject(F.col("headline")))
    outlet = source_identity(F.coalesce("outlet", F.lit("")))
    bucket = F.when(F.col("_url").isNotNull(), F.concat(F.lit("host:"), host_of(F.col("_url")))).when(outlet != "", F.concat(F.lit("outlet:"), outlet)).otherwise(F.concat(F.lit("nopub:"), F.col("source_id")))
    kind = F.when(F.col("_live").isNotNull(), "live").when(F.col("_head") == "", "alone").when(F.col("_url").isNotNull(), "url").otherwise("headline")
    keyed = keyed.withColumn("merge_kind", kind)
    key = (
        F.when(kind == "live", F.concat_ws("\u0001", bucket, F.col("_live"))).when(kind == "alone", F.coalesce(F.col("source_id"), F.concat(F.lit("idx"), F.col("seq").cast("string"))))
        .when(kind == "url", F.concat_ws("\u0001", "_url", "_head")).otherwise(F.col("_head"))
    )
    return keyed.withColumn("merge_key", key).drop("_url", "_head", "_live")


def dedupe_items(items: DataFrame) -> DataFrame:
    """One winner a group, with n_duplicates, duplicates (losers) and first_seq (the group's place).

    Live and url groups are split by anchored windows. Winners have more
    evidence, then are fresher, heavier and first by ids; live ones are fresher first.
    """
    keyed = merge_keys(items)
    timed = keyed.filter("merge_kind in ('live', 'url')")
    split = anchored_windows(timed, ["merge_kind", "merge_key"], "minutes_ago", "source_id")
    alone = F.when(F.col("anchor").isNull(), F.col("seq"))
    grouped = split.withColumn("_alone", alone).unionByName(keyed.filter("merge_kind in ('headline', 'alone')").withColumn("anchor", F.lit(None).cast("double")).withColumn("_alone", F.lit(None).cast("long")))
    evidence = F.col("evidence") if "evidence" in items.columns else richness(F.col("body"), F.col("headline"), F.col("byline") if "byline" in items.columns else None)
    age = F.coalesce(finite(F.col("minutes_ago")), F.lit(float("inf")))
    weight = F.coalesce(finite(F.col("weight")), F.lit(0.0))
    place = F.struct(F.when(F.col("merge_kind") == "live", age).alias("live"), (-evidence).alias("e"), age.alias("age"), (-weight).alias("w"), F.coalesce("feed_id", F.lit("")).alias("feed"), "source_id", "seq")
    loser = F.struct("source_id", "feed_id", "outlet", (F.col("url") if "url" in items.columns else F.lit(None).cast("string")).alias("url"), "weight")
    # every group becomes one row, so that the losers of a large one are held once
    groups = grouped.groupBy("merge_kind", "merge_key", "anchor", "_alone").agg(
        F.min("seq").alias("first_seq"), (F.count("*") - 1).alias("n_duplicates"), F.min_by(F.struct(*items.columns), place).alias("_winner"),
        F.min(place).alias("_place"), F.collect_list(F.struct(place.alias("p"), loser.alias("l"))).alias("_all"),
    )
    losers = F.array_sort(F.transform(F.filter("_all", lambda x: x["p"] != F.col("_place")), lambda x: x["l"]))
    return groups.select("_winner.*", "merge_kind", "first_seq", "n_duplicates", losers.alias("duplicates"))
