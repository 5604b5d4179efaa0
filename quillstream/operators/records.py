"""Stories that stand on their evidence: what is checked, dropped and written anew, and the plainest stories of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped_summary, collapsed, story_id, trimmed

_NONE = "array<string>"


def claims_summary(claims: Column, summary: Column) -> Column:
    """The claims as sentences, within the length of a summary; the summary itself where there is none."""
    own = F.filter(F.transform(F.coalesce(claims, F.array().cast(_NONE)), lambda c: collapsed(F.coalesce(c, F.lit("")))), lambda c: c != "")
    closed = F.transform(own, lambda c: F.when(c.rlike("[.!?]$"), c).otherwise(F.concat(c, F.lit("."))))
    return F.when(F.size(own) > 0, capped_summary(F.array_join(closed, " "))).otherwise(collapsed(F.coalesce(summary, F.lit(""))))


def grounded(stories: DataFrame, items: DataFrame) -> DataFrame:
    """Stories with ``failure`` (no_valid_source_ids, ungrounded_claims, partial_source_ids, or null), and the sound ones' lines from their claims.

    stories: story_id, source_ids, claims, evidence (claim number -> source ids),
    subtitle, summary; items: source_id. Unknown sources are cut from a story that
    fails for them. A sound story's subtitle is its first claim and its summary all
    of them, so that nothing is published that no evidence bears out.
    """
    named = F.array_distinct(F.concat(F.coalesce("source_ids", F.array().cast(_NONE)), F.flatten(F.coalesce(F.map_values("evidence"), F.array().cast("array<array<string>>")))))
    asked = stories.select("story_id", F.explode(named).alias("source_id"))
    known = asked.join(items.select("source_id").distinct(), "source_id", "left_semi").groupBy("story_id").agg(F.collect_set("source_id").alias("_known"))
    rows = stories.join(known, "story_id", "left").withColumn("_known", F.coalesce("_known", F.array().cast(_NONE)))
    rows = rows.withColumn("_there", F.filter(F.coalesce("source_ids", F.array().cast(_NONE)), lambda x: F.array_contains("_known", x)))
    claims = F.coalesce("claims", F.array().cast(_NONE))
    bad = F.exists(F.transform(claims, lambda _, i: ~F.arrays_overlap(F.coalesce(F.try_element_at("evidence", i.cast("string")), F.array().cast(_NONE)), "_known")), lambda x: F.coalesce(x, F.lit(True)))
    failure = F.when(F.size("_there") == 0, "no_valid_source_ids").when(bad, "ungrounded_claims").when(F.size("_there") < F.size("source_ids"), "partial_source_ids")
    rows = rows.withColumn("failure", failure)
    sound = F.col("failure").isNull() & (F.size(claims) > 0)
    new = {
        "source_ids": F.when(F.col("failure") == "partial_source_ids", F.col("_there")).otherwise(F.col("source_ids")),
        "subtitle": F.when(sound, collapsed(F.coalesce(F.get(claims, F.lit(0)), F.lit("")))).otherwise(F.col("subtitle")),
        "summary": F.when(sound, claims_summary(claims, F.col("summary"))).otherwise(F.col("summary")),
    }
    return rows.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in stories.columns), "failure")


def single_story(source_id: Column, outlet: Column, headline: Column, topics: Column, keywords: Column, geographies: Column) -> Column:
    """The story of one item, in its own words: struct of id, lines, sources, tags, entities, claim and evidence."""
    head, outlet = trimmed(F.coalesce(headline, F.lit(""))), trimmed(F.coalesce(outlet, F.lit("")))
    said = F.concat(outlet, F.lit(" reports: "), head)
    title = F.when(head != "", head).when(outlet != "", F.concat(outlet, F.lit(" report"))).otherwise("Source report")
    both = (outlet != "") & (head != "")
    summary = F.when(both, F.concat(said, F.lit("."))).when(head != "", F.concat(head, F.lit("."))).when(outlet != "", F.concat(outlet, F.lit(" report."))).otherwise("Source report.")
    unique = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast(_NONE)), lambda x: F.trim(x)), lambda x: x != ""))
    tags = [unique(c) for c in (topics, keywords, geographies)]
    ids = F.array(source_id)
    return F.struct(
        story_id(ids, F.try_element_at(tags[0], F.lit(1))).alias("story_id"), title.alias("title"), F.when(outlet != "", F.concat(F.lit("Reported by "), outlet, F.lit("."))).otherwise("Single-source report.").alias("subtitle"),
        summary.alias("summary"), ids.alias("source_ids"), *(c.alias(n) for n, c in zip(("topics", "keywords", "geographies"), tags, strict=True)), F.array_distinct(F.concat(*tags)).alias("entities"),
        F.array(F.when(both, said).otherwise(title)).alias("claims"), F.create_map(F.lit("0"), ids).alias("evidence"),
    )


def topic_stories(items: DataFrame, by: str, per_story: int = 5, most: int = 5) -> DataFrame:
    """Plain stories by topic where no model clusters: the first ``most`` topics of each ``by``, each with its first items.

    items: by, seq, source_id, outlet, headline, topic, geographies. Topics are in
    order of appearance; an item without one counts as General.
    """
    from .ranking import top_per_key

    rows = items.withColumn("topic", F.when(F.coalesce("topic", F.lit("")) == "", "General").otherwise(F.col("topic")))
    first = top_per_key(rows.groupBy(by, "topic").agg(F.min("seq").alias("first")), [by], [F.col("first").asc()], most).select(by, "topic", "first")
    own = top_per_key(rows.join(first, [by, "topic"]), [by, "topic"], [F.col("seq").asc()], per_story, "_n")
    g = own.groupBy(by, "topic", "first").agg(F.array_sort(F.collect_list(F.struct("_n", "source_id", "outlet", "headline", "geographies"))).alias("i"))
    title = F.concat("topic", F.lit(" Updates"))
    ids, heads = F.transform("i", lambda x: x["source_id"]), F.transform("i", lambda x: x["headline"])
    claims = F.transform("i", lambda x: F.concat(x["outlet"], F.lit(" reports: "), x["headline"]))
    return g.select(
        by, "first", story_id(ids, F.col("topic")).alias("story_id"), title.alias("title"), F.concat(F.lit("Recent "), F.lower("topic"), F.lit(" updates.")).alias("subtitle"),
        F.concat(title, F.lit(". "), F.array_join(F.slice(heads, 1, 3), "; "), F.lit(".")).alias("summary"), ids.alias("source_ids"), F.array("topic").alias("topics"),
        F.array_distinct(F.flatten(F.transform("i", lambda x: F.coalesce(x["geographies"], F.array().cast(_NONE))))).alias("geographies"), claims.alias("claims"),
        F.map_from_entries(F.transform("i", lambda x, k: F.struct(k.cast("string").alias("key"), F.array(x["source_id"]).alias("value")))).alias("evidence"),
    )
