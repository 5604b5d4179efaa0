"""Sources that readers add, aliases, rejections, snippets, fallbacks and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import REJECTIONS_KEPT, STORY_CAP, WRITER_FAILURES
from .ranking import top_per_key


def added(new: DataFrame, old: DataFrame, by: list[str]) -> DataFrame:
    """The keys that the new settings have and the old ones have not, once each."""
    return new.select(*by).distinct().join(old.select(*by).distinct(), by, "left_anti")


def alias_names(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(alias, canonical) by lower-cased raw and normalised spelling; of equal spellings the last row's, its raw one over its normalised one.

    aliases: seq, raw, normalized, entity; entities: entity, canonical. Blank spellings and names give none.
    """
    known = entities.select("entity", F.trim("canonical").alias("canonical")).filter("canonical != ''")
    both = F.array(*(F.struct(F.lit(i).alias("i"), F.lower(F.trim(c)).alias("alias")) for i, c in enumerate(("normalized", "raw"))))
    rows = aliases.join(known, "entity").select("seq", "canonical", F.explode(both).alias("s")).filter("s.alias != ''")
    return rows.groupBy(F.col("s.alias").alias("alias")).agg(F.max_by("canonical", F.struct("seq", "s.i")).alias("canonical"))


def with_rejections(log: DataFrame, new: DataFrame, kept: int = REJECTIONS_KEPT) -> DataFrame:
    """The log (user, key, at) with the first of each new key that it lacks; of each user the newest ``kept``.

    Of equal times the greater key comes first.
    """
    fresh = new.groupBy("user", "key").agg(F.min("at").alias("at")).join(log.select("user", "key"), ["user", "key"], "left_anti")
    both = log.select("user", "key", "at").unionByName(fresh.select("user", "key", "at"))
    return top_per_key(both, ["user"], [F.col("at").desc(), F.col("key").desc()], kept).drop("rank")


def _on_axis(name: str, tags: Column) -> Column:
    """Structs (axis, tag) of an array of tags; of null, none."""
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.struct(F.lit(name).alias("axis"), t.alias("tag")))


def snippets_for(stories: DataFrame, snippets: DataFrame, most: int = 3) -> DataFrame:
    """(story, id, place): the snippets that share a topic or geography with a story, by shared keywords, geographies, state and id.

    Both sides: topics, geographies, keywords, state; stories have ``story``, snippets ``id``. Tags
    meet by equal values, so that no pair without a shared tag is looked at.
    A tag that a snippet names twice counts twice.
    """

    def tags(rows: DataFrame, key: str) -> DataFrame:
        axes = [_on_axis(n, c) for n, c in (("topic", F.col("topics")), ("geo", F.col("geographies")), ("keyword", F.transform("keywords", F.lower)))]
        return rows.select(key, F.explode(F.concat(*axes)).alias("t")).select(key, "t.axis", "t.tag").filter("tag != ''")

    theirs = tags(snippets.filter("id is not null"), "id").groupBy("id", "axis", "tag").agg(F.count("*").alias("n"))
    shared = tags(stories, "story").distinct().join(theirs, ["axis", "tag"]).groupBy("story", "id")
    counts = shared.agg(*(F.coalesce(F.sum(F.when(F.col("axis") == a, F.col("n"))), F.lit(0)).alias(a) for a in ("topic", "geo", "keyword"))).filter("topic > 0 or geo > 0")
    rows = counts.join(snippets.select("id", F.col("state").alias("_state")), "id").join(stories.select("story", "state"), "story")
    order = [F.col("keyword").desc(), F.col("geo").desc(), F.coalesce(F.col("state") == F.col("_state"), F.lit(False)).desc(), F.col("id").asc()]
    return top_per_key(rows, ["story"], order, most, "place").select("story", "id", "place")


def fallback_stories(items: DataFrame, order: list[Column], most: int = STORY_CAP) -> tuple[DataFrame, DataFrame]:
    """The items that stand for stories when clustering fails, and (reason, n) of those left out, every reason listed.

    items: included, source_id, topic_fit, keyword_fit; only those of all four qualify.
    """
    reason = (
        F.when(~F.coalesce("included", F.lit(False)), "not_beat_fit_included").when(F.coalesce(F.trim("source_id"), F.lit("")) == "", "missing_source_id")
        .when(~F.coalesce(F.col("topic_fit") > 0, F.lit(False)), "no_topic_fit").when(~F.coalesce(F.col("keyword_fit") > 0, F.lit(False)), "no_keyword_fit")
    )
    rows = items.withColumn("_reason", reason)
    fails = ("not_beat_fit_included", "missing_source_id", "no_topic_fit", "no_keyword_fit")
    counts = rows.agg(*(F.count_if(F.col("_reason") == r).alias(r) for r in fails), F.greatest(F.count_if(F.col("_reason").isNull()) - most, F.lit(0)).alias("over_cap"))
    return rows.filter("_reason is null").drop("_reason").orderBy(*order).limit(most), counts.unpivot([], counts.columns, "reason", "n")


def lane(signal: Column, chosen: Column) -> Column:
    """1 for chosen items with a geography signal, else 2."""
    return F.when(signal & chosen, 1).otherwise(2)


def lane_order(signal: Column, chosen: Column) -> list[Column]:
    """Items with a signal first, then chosen ones, then the freshest; source_id settles ties."""
    return [signal.desc(), chosen.desc(), F.col("minutes_ago").asc_nulls_last(), F.col("source_id").asc()]


def writer_failed(fallback: Column, reason: Column) -> Column:
    """Is a line a stand-in because its writer failed (not by settings or checks)?"""
    return F.coalesce(fallback & reason.isin(*WRITER_FAILURES), F.lit(False))


def stability(stories: DataFrame, by: list[str], failed: dict[str, Column]) -> DataFrame:
    """Per key: eligible, survived and dropped stories, those that failed in each stage, and the share retained."""
    any_failed = F.lit(False)
    for f in failed.values():
        any_failed = any_failed | f
    out = stories.groupBy(*by).agg(F.count("*").alias("eligible"), F.count_if(any_failed).alias("dropped"), *(F.count_if(f).alias(n) for n, f in failed.items()))
    return out.withColumn("survived", F.col("eligible") - F.col("dropped")).withColumn("retention_rate", F.col("survived") / F.col("eligible"))


def published(new: DataFrame, prior: DataFrame) -> DataFrame:
    """(user, story, from_prior): the new stories, or a user's prior ones where clustering failed and left none.

    new: user, story, failed; a failed run without stories is a row whose story is null.
    """
    state = new.groupBy("user").agg(F.bool_or("failed").alias("failed"), F.count("story").alias("n"))
    keep = prior.join(state.filter("failed and n = 0").select("user"), "user", "left_semi")
    return new.filter("story is not null").select("user", "story", F.lit(False).alias("from_prior")).unionByName(keep.select("user", "story", F.lit(True).alias("from_prior")))


def anchors(snapshots: DataFrame) -> DataFrame:
    """(user, anchor): when each snapshot was last looked at, by its payload, else refreshed."""
    return snapshots.select("user", F.coalesce(F.try_to_timestamp(F.get_json_object("payload", "$._lastCheckedAt")), F.col("refreshed_at")).alias("anchor"))


def broken_rules(rows: DataFrame, unique: dict[str, list[str]], tests: dict[str, Column]) -> DataFrame:
    """(rule, n): how many keys are there twice or more (null keys are free), how many rows fail a test (null passes)."""
    failing = rows.agg(*(F.count_if(~t).alias(n) for n, t in tests.items()))
    out = failing.unpivot([], failing.columns, "rule", "n")
    for name, key in unique.items():
        twice = rows.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
        out = out.unionByName(twice.agg(F.lit(name).alias("rule"), F.count("*").alias("n")))
    return out


def tag_sections(stories: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, tag, place): the distinct tags of each axis over all stories, in the order of code points."""
    named = F.concat(*(_on_axis(a, F.col(a)) for a in axes))
    rows = stories.select(F.explode(named).alias("t")).select("t.axis", "t.tag").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("axis").orderBy("tag")))
