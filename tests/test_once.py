"""Texts are trimmed without a pattern, and no step of a check is worked out once for each of its uses."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from quillstream.functions.answers import trimmed_region
from quillstream.functions.scoring import mock_embedding
from quillstream.functions.text import BLANK, bound, trimmed
from quillstream.operators.semantic import item_text, recall_text
from quillstream.plans.registered import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trimmed_takes_every_blank_and_nothing_else(spark):
    marks = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    texts = [f"{x}{y}a{x}b {x}" for x in marks[:0x300] + marks[0x1600:0x1700] + marks[0x2000:0x2100] + marks[0x3000:0x3010] + marks[-600:] for y in ("", " ")] + ["", " \n", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", trimmed(F.col("t")).alias("x"))
    assert all(r["x"] == (r["t"] if r["t"] is None else re.sub(rf"\A{BLANK}+|{BLANK}+\Z", "", r["t"])) for r in got.collect())
    assert "regexp_replace" not in _plan(got)


def test_bound_values(spark):
    assert [r[0] for r in spark.createDataFrame([(1,), (None,)], "a int").select(bound(F.col("a") + 1, lambda x: F.coalesce(x * x, F.lit(0)))).collect()] == [4, 0]


def test_sentences_are_cut_once(spark, small):
    # once for what is kept, once for their number, as regexp_count is worked out by it
    assert _plan(QUERIES["prose_checks"](spark, small)).count("regexp_extract_all(") == 2


def test_a_vector_hashes_its_text_once(spark):
    got = spark.createDataFrame([("",), ("é",), (None,)], "t string").select("t", mock_embedding(F.col("t")).alias("v"))
    assert [r["v"] for r in got.collect()] == [t if t is None else [(b - 128) / 128 for b in hashlib.sha256(t.encode()).digest()] for t in ("", "é", None)]
    assert "sha2(" not in _plan(got).partition("lambdafunction(")[2]


def test_a_text_of_an_item_is_joined_once(spark):
    rows = spark.createDataFrame([(" h ", None, [" a", "", "b\n"]), ("", "s", None), (None, " ", [" "])], "h string, s string, b array<string>")
    got = rows.select(item_text(*map(F.col, "hsb")), recall_text(*map(F.col, "hsb")))
    assert [tuple(r) for r in got.collect()] == [("h. a  b", "h — a  b"), ("s", "s"), ("", "")]
    assert all(_plan(rows.select(made(*map(F.col, "hsb")))).count("coalesce(b#") == 1 for made in (item_text, recall_text))


def test_a_region_is_looked_for_in_a_text_mended_once(spark):
    got = spark.createDataFrame([('x ```json\n{"a": [1]} ``` y',), ("[1] {", ), ("none",), (None,)], "t string").select(trimmed_region(F.col("t")).alias("r"))
    assert [r[0] for r in got.collect()] == ['{"a": [1]}', "[1]", None, None] and _plan(got).count("regexp_replace(") == 1
