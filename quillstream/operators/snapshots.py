"""Readers' snapshots, settings and narratives: written as versions, brought to today's form when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.store import VersionedTables
from .tagging import _without_places

_TAGS = "struct<topics: array<string>, keywords: array<string>, geographies: array<string>>"
_SOURCE = "struct<sourceId: string, outlet: string, kind: string, weight: double, url: string, minutesAgo: double, headline: string, body: array<string>>"
_STORY = f"struct<metaStoryId: string, title: string, subtitle: string, takeaway: string, summary: string, whatChanged: string, whyItMatters: string, tags: {_TAGS}, sources: array<{_SOURCE}>>"
PAYLOAD = f"contractVersion string, stories array<{_STORY}>, _everSeenMetaStoryIds array<string>, _lastCheckedAt string"
#: Parts of a run's own report that a snapshot shows, each as JSON.
REPORTED = ("funnel", "recall", "translation", "beatFit", "clusterModel", "embeddingModel", "usedFallbackClustering", "clusteringFailureReason", "tags", "whatChanged", "whyItMatters", "clusterSplit", "overflowCap", "clusterCap", "timings", "outcomes", "ingestion")

SNAPSHOTS, SETTINGS, NARRATIVES = "snapshots", "settings", "narratives"


def store(spark: SparkSession, path: str) -> VersionedTables:
    """snapshots (user_id, payload, refreshed_at), settings (user_id, data, contract_version), narratives (user_id, submitted_at, raw_text)."""
    return VersionedTables(spark, path, {SNAPSHOTS: ["user_id"], SETTINGS: ["user_id"], NARRATIVES: ["user_id", "submitted_at"]})


def current_version(version: Column) -> Column:
    """A contract version, the older ones that today's form still covers as today's; unknown ones as they are."""
    return F.when(version.isin(*fixed.LEGACY_CONTRACTS), fixed.CONTRACT).otherwise(version)


def lifted_subtitle(subtitle: Column, takeaway: Column) -> Column:
    """The subtitle, or what older stories have in its place."""
    return F.when(F.length(subtitle) > 0, subtitle).when(F.length(takeaway) > 0, takeaway).otherwise(subtitle)


def contract_kind(kind: Column) -> Column:
    """Kinds as stories show them: social, all else traditional."""
    return F.when(kind == "social", "social").otherwise("traditional")


def loaded_stories(stories: Column) -> Column:
    """Stored stories in today's form: subtitles lifted and takeaways gone, tags on all axes, kinds of sources mapped; no list is null."""
    none = F.array().cast("array<string>")

    def one(s: Column) -> Column:
        sources = F.transform(F.coalesce(s["sources"], F.array().cast(f"array<{_SOURCE}>")), lambda x: x.withField("kind", contract_kind(x["kind"])))
        tags = F.struct(*(F.filter(F.coalesce(s["tags"][a], none), lambda t: t.isNotNull()).alias(a) for a in ("topics", "keywords", "geographies")))
        return s.withField("subtitle", lifted_subtitle(s["subtitle"], s["takeaway"])).withField("tags", tags).withField("sources", sources).dropFields("takeaway")

    return F.transform(F.coalesce(stories, F.array().cast(f"array<{_STORY}>")), one)


def loaded(rows: DataFrame) -> DataFrame:
    """Snapshots (user_id, payload, refreshed_at) as they are shown: user_id, contract_version, stories, ever_seen, refreshed_at, last_checked_at, report (map of JSON).

    A payload that is no JSON object gives no story and no version.
    """
    parsed = rows.select("user_id", "refreshed_at", "payload", F.from_json("payload", PAYLOAD).alias("p"))
    report = F.create_map(*(x for name in REPORTED for x in (F.lit(name), F.get_json_object("payload", f"$._lastRunMeta.{name}"))))
    return parsed.select(
        "user_id", current_version(F.col("p.contractVersion")).alias("contract_version"), loaded_stories(F.col("p.stories")).alias("stories"),
        F.coalesce("p._everSeenMetaStoryIds", F.array().cast("array<string>")).alias("ever_seen"), "refreshed_at", F.col("p._lastCheckedAt").alias("last_checked_at"),
        F.map_filter(report, lambda _, v: v.isNotNull()).alias("report"),
    )


def touched(snapshots: DataFrame, checked: DataFrame) -> DataFrame:
    """Snapshots of the users of ``checked`` (user_id, at) with when they were last looked at; refreshed_at and the rest stay."""
    when = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.regexp_replace(F.trim("payload"), r'(?s)("_lastCheckedAt"\s*:\s*)"[^"]*"', "$1\"{at}\"")
    stamped = F.when(F.get_json_object("payload", "$._lastCheckedAt").isNotNull(), F.replace(body, F.lit("{at}"), when))
    fresh = F.concat(F.lit('{"_lastCheckedAt":"'), when, F.when(F.trim("payload").rlike(r"^\{\s*\}$"), F.lit('"}')).otherwise(F.concat(F.lit('",'), F.substr(F.trim("payload"), F.lit(2)))))
    return snapshots.join(checked, "user_id").select("user_id", F.coalesce(stamped, fresh).alias("payload"), "refreshed_at")


def merged_settings(rows: DataFrame) -> DataFrame:
    """(user_id, settings): each field of a row's data as JSON text by its name, and the version; the column's counts."""
    own = F.map_filter(F.coalesce(F.from_json("data", "map<string, string>"), F.create_map().cast("map<string, string>")), lambda k, _: k != "contractVersion")
    return rows.select("user_id", F.when(F.col("contract_version").isNull(), own).otherwise(F.map_concat(own, F.create_map(F.lit("contractVersion"), "contract_version"))).alias("settings"))


def save_settings(own: VersionedTables, settings: DataFrame, narratives: DataFrame, label: str | None = None) -> int:
    """Settings and narratives in one commit: readers see both or neither."""
    return own.commit({SETTINGS: settings, NARRATIVES: narratives}, label)


def current_narratives(rows: DataFrame) -> DataFrame:
    """(user_id, submitted_at, raw_text, is_current): the newest narrative of each user is the current one."""
    newest = rows.groupBy("user_id").agg(F.max("submitted_at").alias("_newest"))
    return rows.join(newest, "user_id").withColumn("is_current", F.col("submitted_at") == F.col("_newest")).drop("_newest")


def backfilled(settings: DataFrame) -> DataFrame:
    """Settings (user_id, keywords, geographies) whose keywords name a geography of theirs, without these; the others need no change and are left out."""
    kept = _without_places(F.col("keywords"), F.col("geographies"))
    kept = F.when(F.size("geographies") > 0, F.filter(kept, lambda k: F.trim(k) != "")).otherwise(F.col("keywords"))
    return settings.filter("keywords is not null and geographies is not null").withColumn("_kept", kept).filter("_kept != keywords").withColumn("keywords", F.col("_kept")).drop("_kept")
