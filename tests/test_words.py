"""Words of a text are found once a row, by a class that leaves out no character."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillstream.functions.text import words_of
from quillstream.plans.registered import QUERIES


def test_words_are_split_at_every_other_character(spark):
    others = "".join(chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000)
    texts = [f"Ab_1{x}cD" for x in others[:700]] + ["", " a", "a ", "Ünï\U0001f600x", "".join(others[700:])]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower("t").alias("l"), words_of(F.col("t")).alias("w")).collect()
    assert all(r["w"] == re.split("[^a-z0-9_]+", r["l"]) for r in got) and len(got) == len(texts)


def test_a_text_is_split_once_for_all_keywords(spark, small):
    plan = QUERIES["tag_assign"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1


def test_tags_are_not_matched_by_a_negated_class(spark, small):
    assert "[^a-z0-9_]" not in QUERIES["tag_fits"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
