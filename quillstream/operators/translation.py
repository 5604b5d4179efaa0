"""Translations of evidence, kept by content: which items need one, what of them is translated, in which order, and how far it covers stories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.prose import segments_hash
from ..functions.text import trimmed
from ..sources.store import VersionedTables
from .reports import not_english

TRANSLATIONS = "translations"
_NONE = "array<string>"


def evidence_segments(headline: Column, body: Column, most_chars: int = fixed.TRANSLATED_CHARS, most_snippets: int = fixed.TRANSLATED_SNIPPETS) -> Column:
    """The headline and the first snippets of the body within ``most_chars`` characters together; the headline's place stays if it is empty."""
    lines = F.filter(F.transform(F.coalesce(body, F.array().cast(_NONE)), lambda x: trimmed(F.coalesce(x, F.lit("")))), lambda x: x != "")
    all_ = F.concat(F.array(trimmed(F.coalesce(headline, F.lit("")))), F.slice(lines, 1, most_snippets))
    start = F.struct(F.lit(0).alias("used"), F.array().cast(_NONE).alias("out"))

    def add(state: Column, segment: Column) -> Column:
        clipped = F.substr(segment, F.lit(1), F.lit(most_chars) - state["used"])
        return F.when(state["used"] >= most_chars, state).otherwise(F.struct((state["used"] + F.length(clipped)).alias("used"), F.array_append(state["out"], clipped).alias("out")))

    return F.aggregate(all_, start, add)["out"]


def translation_key(source_id: Column, lang: Column, segments: Column) -> Column:
    return F.concat_ws("::", F.coalesce(source_id, F.lit("__no_id")), F.lower(trimmed(lang)), segments_hash(segments))


def translated_items(cache: VersionedTables, items: DataFrame, translate: Callable[[Column, Column], Column] | None, enabled: bool = True) -> DataFrame:
    """Items with normalized_headline, normalized_body and ``translation``: needed, applied, failed, from_cache, reason, lang.

    cache: a store with a table ``translations`` by ``key``; translate(segments,
    lang) gives the segments in English, as many, or null where it fails. Each
    different evidence is translated once and kept; what fails is not kept and its
    items stay as they are. Without a function, or switched off, nothing is done.
    """
    rows = items.withColumn("_needed", not_english(F.col("lang")))
    text, lines = F.lit(None).cast("string"), F.lit(None).cast(_NONE)
    if translate is None or not enabled:
        reason = F.lit("stage_disabled") if not enabled else F.when(F.col("_needed"), "no_translate_fn")
        state = _state(F.col("_needed"), F.lit(False), F.lit(False), F.lit(False), reason, F.col("lang"))
        return rows.withColumns({"normalized_headline": text, "normalized_body": lines, "translation": state}).drop("_needed")
    rows = rows.withColumn("_segments", F.when(F.col("_needed"), evidence_segments(F.col("headline"), F.col("body"))))
    rows = rows.withColumn("_key", F.when(F.col("_needed"), translation_key(F.col("source_id"), F.col("lang"), F.col("_segments"))))
    wanted = rows.filter("_needed").groupBy(F.col("_key").alias("key")).agg(F.min(F.struct("_segments", F.lower(trimmed("lang")).alias("lang"))).alias("w"))
    known = cache.read(TRANSLATIONS)
    kept = None if known is None else known.select("key", F.lit(True).alias("_cached"))
    misses = wanted if known is None else wanted.join(known, "key", "left_anti")
    own = misses.select("key", F.size("w._segments").alias("n"), translate(F.col("w._segments"), F.col("w.lang")).alias("t")).filter("t is not null and size(t) = n")
    clean = F.filter(F.transform("t", lambda x: trimmed(F.coalesce(x, F.lit("")))), lambda x, i: (i == 0) | (x != ""))
    if not misses.isEmpty():
        cache.commit({TRANSLATIONS: own.select("key", F.get(clean, F.lit(0)).alias("headline"), F.slice(clean, F.lit(2), F.size(clean)).alias("body"))})
    done = cache.read(TRANSLATIONS)
    if done is None:
        return translated_items(cache, items, None)
    done = done.select(F.col("key").alias("_key"), F.col("headline").alias("normalized_headline"), F.col("body").alias("normalized_body"), F.lit(True).alias("_done"))
    out = rows.join(done, "_key", "left")
    out = out.withColumn("_cached", F.lit(False)) if kept is None else out.join(kept.withColumnRenamed("key", "_key"), "_key", "left")
    applied = F.coalesce("_done", F.lit(False))
    failed = F.col("_needed") & ~applied
    state = _state(F.col("_needed"), applied, failed, applied & F.coalesce("_cached", F.lit(False)), F.when(failed, "error"), F.col("lang"))
    return out.withColumn("translation", state).select(*items.columns, "normalized_headline", "normalized_body", "translation")


def _state(needed: Column, applied: Column, failed: Column, cached: Column, reason: Column, lang: Column) -> Column:
    return F.struct(needed.alias("needed"), applied.alias("applied"), failed.alias("failed"), cached.alias("from_cache"), reason.alias("reason"), lang.alias("lang"))


def english_headline(normalized: Column, headline: Column) -> Column:
    return F.when(trimmed(normalized) != "", trimmed(normalized)).otherwise(F.coalesce(headline, F.lit("")))


def english_body(normalized: Column, body: Column) -> Column:
    return F.when(F.size(normalized) > 0, normalized).otherwise(F.coalesce(body, F.array().cast(_NONE)))


def translation_report(items: DataFrame) -> DataFrame:
    """(candidates, needed, translated, failed, cached, degraded_rate) of one stage."""
    n = lambda c: F.count_if(F.col(f"translation.{c}"))
    out = items.agg(F.count("*").alias("candidates"), n("needed").alias("needed"), n("applied").alias("translated"), n("failed").alias("failed"), n("from_cache").alias("cached"))
    return out.withColumn("degraded_rate", F.coalesce(F.try_divide("failed", "needed"), F.lit(0.0)))


def story_coverage(sources: DataFrame, least: float = fixed.COVERAGE) -> DataFrame:
    """(story, sources, covered, needed, translated, coverage, degraded): a source is covered if it needs no translation, or has one."""
    needed, applied = F.col("translation.needed"), F.col("translation.applied")
    out = sources.groupBy("story").agg(F.count("*").alias("sources"), F.count_if(~needed | applied).alias("covered"), F.count_if(needed).alias("needed"), F.count_if(needed & applied).alias("translated"))
    return out.withColumn("coverage", F.col("covered") / F.col("sources")).withColumn("degraded", F.col("coverage") < least)
