"""Stories of one event that clustering left apart: which belong together, and the record that they become."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import evidence_tokens, geography_words, story_id, theme_words, tokens
from .clusters import components
from .stories import similar_links

AXES = ("topics", "keywords", "geographies")


def event_signals(stories: DataFrame, items: DataFrame, by: str, geographies: Sequence[str], theme: Sequence[str] = theme_words()) -> DataFrame:
    """(by, place, token): the words of an event, for stories about the theme that name a configured geography.

    stories: by, place, source_ids, deferred; items: source_id, headline, body (lines).
    The words are those of the headlines, without words of geographies and of the
    theme; theme and geography may be named in the first two lines of body too.
    """
    stops = geography_words(geographies)
    text = F.concat_ws(" ", "headline", F.array_join(F.slice(F.filter("body", lambda x: F.trim(x) != ""), 1, 2), " "))
    known = items.select(
        "source_id", evidence_tokens(F.col("headline"), (*stops, *theme)).alias("own"),
        F.arrays_overlap(tokens(text), F.array(*map(F.lit, theme)).cast("array<string>")).alias("themed"), F.arrays_overlap(tokens(text), F.array(*map(F.lit, stops)).cast("array<string>")).alias("placed"),
    )
    asked = stories.filter(~F.coalesce("deferred", F.lit(False))).select(by, "place", F.explode("source_ids").alias("source_id"))
    found = asked.join(known, "source_id")
    meant = found.groupBy(by, "place").agg(F.bool_or("themed").alias("themed"), F.bool_or("placed").alias("placed")).filter("themed and placed")
    return found.join(meant, [by, "place"], "left_semi").select(by, "place", F.explode("own").alias("token")).distinct()


def ordered_union(arrays: Column) -> Column:
    """Distinct strings of several arrays in order of appearance, without nulls and empty ones."""
    return F.array_distinct(F.filter(F.flatten(F.filter(arrays, lambda a: a.isNotNull())), lambda x: x.isNotNull() & (x != "")))


def merged_record(members: Column) -> dict[str, Column]:
    """The record that stories (an array of structs, in order) become.

    The story of most sources (ties: the least story_id) gives title, subtitle and
    summary. Sources, tags and entities are united in order; claims follow each
    other with new numbers, those without evidence go.
    """
    first = F.array_min(F.transform(members, lambda m, i: F.struct((-F.size(m["source_ids"])).alias("n"), F.coalesce(m["story_id"], F.lit("")).alias("id"), i.alias("i"))))
    primary = F.get(members, first["i"])
    ids = ordered_union(F.transform(members, lambda m: m["source_ids"]))

    def own_claims(m: Column) -> Column:
        def claim(text: Column, i: Column) -> Column:
            given = F.coalesce(F.try_element_at(m["evidence"], i.cast("string")), F.array().cast("array<string>"))
            return F.struct(text.alias("text"), F.filter(given, lambda x: x.isNotNull() & (x != "")).alias("evidence"))

        return F.filter(F.transform(F.coalesce(m["claims"], F.array().cast("array<string>")), claim), lambda c: F.size(c["evidence"]) > 0)

    claims = F.flatten(F.transform(members, own_claims))
    texts = F.transform(claims, lambda c: c["text"])
    out = {
        "title": F.when(F.trim(primary["title"]) != "", primary["title"]).otherwise(F.try_element_at(ids, F.lit(1))),
        "subtitle": F.coalesce(primary["subtitle"], F.lit("")),
        "summary": F.when(F.trim(primary["summary"]) != "", primary["summary"]).otherwise(F.array_join(texts, ". ")),
        "source_ids": ids,
        "claims": texts,
        "evidence": F.map_from_entries(F.transform(claims, lambda c, i: F.struct(i.cast("string").alias("key"), c["evidence"].alias("value")))),
    }
    return out | {name: ordered_union(F.transform(members, lambda m: m[name])) for name in (*AXES, "entities")}  # noqa: B023


def backed_evidence(members: DataFrame, by: str) -> DataFrame:
    """Members (by, root, place, source_ids, evidence, ...) with the evidence that is among the sources of their root.

    A join does it: looked up in a list, each source of a large event would be
    compared with all others.
    """
    given = members.select(by, "root", "place", F.explode("evidence").alias("_claim", "_ids")).select(by, "root", "place", "_claim", F.posexplode("_ids").alias("_i", "_id")).filter("_id != ''")
    known = members.select(by, "root", F.explode("source_ids").alias("_id")).distinct()
    lists = given.join(known, [by, "root", "_id"], "left_semi").groupBy(by, "place", "_claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_id"))), lambda x: x["_id"]).alias("_ids"))
    maps = lists.groupBy(by, "place").agg(F.map_from_entries(F.collect_list(F.struct("_claim", "_ids"))).alias("evidence"))
    return members.drop("evidence").join(maps, [by, "place"], "left").select(*members.columns)


def merge_bundles(
    stories: DataFrame, items: DataFrame, by: str, geographies: Sequence[str], theme: Sequence[str] = theme_words(), least: float = fixed.BUNDLE_JACCARD, shared: int = fixed.BUNDLE_SHARED
) -> DataFrame:
    """The stories of each ``by`` with those of one event merged into one record at the first one's place; n_merged: how many.

    stories: by, place (long), story_id, deferred, title, subtitle, summary,
    source_ids, claims, evidence (claim number -> source ids), entities and the tag
    axes. Two stories are linked if the words of their events share ``shared`` or
    more and overlap by ``least``; components become one. Stories that are deferred,
    off the theme or without a configured geography stay as they are.
    """
    words = event_signals(stories, items, by, geographies, theme).groupBy(by, F.col("place").alias("id")).agg(F.collect_set("token").alias("s")).checkpoint()
    linked = similar_links(words, by, least, shared)
    roots = components(linked, by).withColumnRenamed("id", "place")
    kept = stories.join(roots, [by, "place"], "left")
    alone = kept.filter("root is null").drop("root").withColumn("n_merged", F.lit(1).cast("long"))
    fields = [c for c in stories.columns if c != by]
    groups = backed_evidence(kept.filter("root is not null"), by).groupBy(by, "root").agg(F.collect_list(F.struct(*fields)).alias("m"))
    in_order = F.array_sort("m", lambda x, y: F.when(x["place"] < y["place"], -1).when(x["place"] > y["place"], 1).otherwise(0))  # maps have no order of their own
    groups = groups.withColumn("m", in_order)
    merged = groups.select(by, F.col("root").alias("place"), F.size("m").cast("long").alias("n_merged"), *(c.alias(k) for k, c in merged_record(F.col("m")).items()), F.lit(False).alias("deferred"))
    merged = merged.withColumn("story_id", story_id(F.col("source_ids"), F.try_element_at("topics", F.lit(1))))
    return alone.unionByName(merged.select(*alone.columns))
