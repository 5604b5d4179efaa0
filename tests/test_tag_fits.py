"""Fits of a story's tags are judged by one look at each axis."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstream.functions import tags
from quillstream.functions.text import words_of
from quillstream.operators.tagging import tag_fits
from quillstream.plans.profile import Settings
from quillstream.plans.registered import QUERIES

STORIES = [
    (1, ["Elections "], ["border", "wall"], ["Mexico City"], ["the U.S. Senate", None]),
    (2, ["que\n", "x"], ["new", "york"], [], []),
    (3, None, None, None, None),
    (4, [""], ["a_que", "QUE"], ["los"], ["Übung-que"]),
    (5, ["climate"], [None, "border wall"], [None], []),
    (6, [], ["border"], ["paris"], ["wall", "france"]),
    (7, ["ques"], ["new-york"], ["U.S."], [""]),
]
SETTINGS = [
    Settings(("que", "elections"), ("border wall", "climate"), ("Mexico", "United States", "France")),
    Settings(("immigration",), ("new york", "que"), ("los",)),
    Settings((), (), ("France",)),
    Settings(),
]


@pytest.mark.parametrize("settings", SETTINGS)
def test_fits_together_are_the_fits_one_by_one(spark, settings):
    rows = spark.createDataFrame(STORIES, "story int, topics array<string>, keywords array<string>, geographies array<string>, entities array<string>")
    t, k, g, e = map(F.col, ("topics", "keywords", "geographies", "entities"))
    alone = rows.select(
        "story", tags.topic_fit(t, e, settings.topics).alias("topic_fit"), tags.keyword_fit(k, e, settings.keywords).alias("keyword_fit"), tags.geo_fit(g, e, settings.geographies).alias("geo_fit"),
        tags.strength(t, k).alias("strength"), tags.entity_fit(t, k, g, e, settings).alias("entity_fit"), tags.on_beat(t, k, e, settings).alias("on_beat"),
    )
    together = tag_fits(rows, settings)
    assert together.columns == alone.columns
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, alone.collect()))


def test_plain_tags_are_their_own_words(spark):
    own = spark.createDataFrame([(s[3],) for s in STORIES] + [(s[2],) for s in STORIES], "t array<string>")
    joined = F.array_join(F.coalesce("t", F.array().cast("array<string>")), " ")
    for r in own.select(tags.words(F.col("t")).alias("a"), words_of(joined).alias("b")).collect():
        assert {x for x in r["a"] if x} == {x for x in r["b"] if x}


def test_an_axis_is_looked_through_once_for_all_fits(spark, small):
    plan = QUERIES["tag_fits"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 5  # the text's, and each axis's
