"""Answers of models: trimming, strict and tolerant reading, classes of failures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions import answers

STORY = {"title": "t", "subtitle": "s", "source_item_ids": ["a"], "summary": "x", "tags": {"topics": ["p"], "keywords": [], "geographies": []}, "factual_claims": ["c"], "claim_evidence_map": {"0": ["a"]}}


def read(spark, *raws):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r for r in sorted(answers.parsed_answers(rows).collect(), key=lambda r: r["i"])]


def test_regions(spark):
    cases = {
        "```json\n{\"a\": 1}\n```": '{"a": 1}', "text {\"a\": [1]} more ] end": '{"a": [1]}', "so: [1, {\"b\": 2}] and } this": '[1, {"b": 2}]', "no": None, "}{": None, "": None, "[": None,
        "```[]```": "[]", "{ x } y } z": "{ x } y }", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert [r[0] for r in rows.select(answers.trimmed_region(F.col("raw"))).collect()] == list(cases.values())


def test_sound_and_mended(spark):
    own = json.dumps({"meta_stories": [STORY | {"associated_entities": ["e"], "extra": 1}]})
    got = read(spark, own, f"  {own}\n", f"```json\n{own}```", f"Sure!\n{own}\nDone.", json.dumps([STORY]), '{"meta_stories": []}', json.dumps({"meta_stories": [STORY] * 5}))
    assert [(r["repair"]["attempted"], r["repair"]["succeeded"], r["repair"]["coercion"], len(r["stories"])) for r in got] == [
        (False, False, None, 1), (False, False, None, 1), (True, True, None, 1), (True, True, None, 1), (True, True, "array_wrap", 1), (False, False, None, 0), (False, False, None, 5),
    ]
    first = got[0]["stories"][0].asDict(recursive=True)
    assert first == STORY | {"associated_entities": ["e"]}
    assert got[4]["repair"]["bucket"] == "invalid_type" and got[2]["repair"]["bucket"] is None


@pytest.mark.parametrize(
    "broken, bucket",
    [
        ({"title": 5}, "invalid_type"), ({"title": None}, "invalid_type"), ({"summary": ""}, "empty_string_field"), ({"source_item_ids": "a"}, "invalid_type"), ({"source_item_ids": [""]}, "empty_source_item_ids"),
        ({"source_item_ids": ["a", 1]}, "invalid_type"), ({"source_item_ids": list("abcdef")}, "too_many_source_item_ids"), ({"factual_claims": []}, "empty_string_field"), ({"tags": {"topics": [], "keywords": []}}, "missing_required_field"),
        ({"tags": []}, "invalid_type"), ({"claim_evidence_map": {"0": "a"}}, "invalid_type"), ({"claim_evidence_map": {"0": [1]}}, "invalid_type"), ({"associated_entities": None}, "invalid_type"), ({"title": "", "source_item_ids": []}, "empty_string_field"),
    ],
)
def test_first_broken_rule(spark, broken, bucket):
    (r,) = read(spark, json.dumps({"meta_stories": [STORY, STORY | broken, {}]}))
    assert r["stories"] is None and (r["repair"]["failure_reason"], r["repair"]["raw_class"], r["repair"]["bucket"]) == ("schema_validation_error", "schema_validation_error", bucket)


def test_failures(spark):
    got = read(spark, None, "5", "null", '{"meta_stories": {}}', '[{"a": 1}]', '{"a": 1,}', "[1]")
    assert [tuple(r["repair"][c] for c in ("failure_reason", "raw_class", "bucket")) for r in got] == [
        ("no_json_region", "empty_response", None), ("no_json_region", "schema_validation_error", "invalid_type"), ("no_json_region", "schema_validation_error", "invalid_type"),
        ("schema_validation_error", "schema_validation_error", "missing_meta_stories"), ("schema_validation_error", "schema_validation_error", "missing_required_field"), ("json_parse_error", "json_parse_error", None),
        ("schema_validation_error", "schema_validation_error", "invalid_type"),
    ]
    assert all(not r["repair"]["succeeded"] and r["stories"] is None for r in got)


def test_subtypes(spark):
    rows = [("Request timed out", None, None, True), ("bad", None, None, True), ("bad", 500, None, False), ("bad", None, "APIConnectionError", False), ("returned empty clustering\n response", None, None, None), ("HTTP 429", None, None, None), ("odd 4290", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "m string, s int, n string, u boolean")
    assert [r[0] for r in df.select(answers.failure_subtype(*map(F.col, "msnu"))).collect()] == ["timeout_budget", "parse", "provider_request", "provider_request", "provider_request", "provider_request", "unknown", "unknown"]


def test_verdicts(spark):
    raws = ['```json\n{"material": true, "confidence": 1.7, "reasonCode": "r"}\n```', '{"material": false, "confidence": "high"}', '{"material": "yes"}', "[]", "x", None, '{"material": true, "confidence": -1, "reasonCode": 4}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r["v"] and tuple(r["v"]) for r in df.select("i", answers.change_verdict(F.col("raw")).alias("v")).orderBy("i").collect()]
    assert got == [(True, 1.0, "r"), (False, 0.0, ""), None, None, None, None, (True, 0.0, "")]
    assert [r[0] for r in df.select("i", answers.confidence(F.col("raw")).alias("c")).orderBy("i").select("c").collect()] == [1.0, 0.0, 0.0, 0.0, None, None, 0.0]
