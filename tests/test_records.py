"""Grounded stories, plain stories, deltas, guards and semantic scores against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quillstream.functions.text import capped_summary
from quillstream.operators import changes, records, semantic
from quillstream.sources.store import VersionedTables


def plain_cap(text, most=500):
    if len(text) <= most:
        return text
    head = text[:most].rstrip()
    stop = head.rfind(". ")
    if stop >= math.floor(most * 0.6):
        return head[: stop + 1]
    blank = head.rfind(" ")
    return (head[:blank] if blank > 0 else head) + "…"


def test_summaries_are_cut_at_sentences(spark):
    rng = random.Random(1)
    texts = ["a" * 40, "", "x" * 20, "ab. " * 9, "a " * 30, "one two. three four five six", " lead", ". " * 12]
    texts += ["".join(rng.choice(("ab", " ", ". ", ".", "é", "c. d")) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(capped_summary(F.col("t"), 20)).collect()] == [plain_cap(t, 20) for t in texts]


STORY = "story_id string, source_ids array<string>, claims array<string>, evidence map<string, array<string>>, subtitle string, summary string, own int"


def test_grounding(spark):
    stories = [
        ("ok", ["a", "b"], [" First  claim ", "Second!", ""], {"0": ["a"], "1": ["zz", "b"], "2": ["a"]}, "s", "m", 1),
        ("none", ["zz"], ["c"], {"0": ["a"]}, "s", "m", 1), ("null", None, None, None, "s", "m", 1), ("bad", ["a", "zz"], ["c", "d"], {"0": ["a"], "1": ["zz"]}, "s", "m", 1),
        ("missing", ["a"], ["c", "d"], {"0": ["a"]}, "s", "m", 1), ("part", ["zz", "a"], ["c"], {"0": ["a"]}, "s", "m", 1), ("bare", ["a"], [], {}, "s", " m  n ", 1),
    ]
    got = {r["story_id"]: r for r in records.grounded(spark.createDataFrame(stories, STORY), spark.createDataFrame([("a",), ("b",), ("b",)], "source_id string")).collect()}
    assert {k: r["failure"] for k, r in got.items()} == {"ok": None, "none": "no_valid_source_ids", "null": "no_valid_source_ids", "bad": "ungrounded_claims", "missing": "ungrounded_claims", "part": "partial_source_ids", "bare": None}
    assert (got["ok"]["subtitle"], got["ok"]["summary"]) == ("First claim", "First claim. Second!")
    assert got["part"]["source_ids"] == ["a"] and got["part"]["summary"] == "m" and got["bad"]["source_ids"] == ["a", "zz"] and got["bare"]["summary"] == " m  n "


def test_plain_stories(spark):
    rows = spark.createDataFrame([("1", "Out", " Head "), ("2", "", "Head"), ("3", "Out", ""), ("4", None, None)], "id string, o string, h string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in rows.select(records.single_story(F.col("id"), F.col("o"), F.col("h"), F.array(F.lit(" t "), F.lit("t")), none, F.array(F.lit("g")))).collect()]
    assert [(s["title"], s["subtitle"], s["summary"], s["claims"]) for s in got] == [
        ("Head", "Reported by Out.", "Out reports: Head.", ["Out reports: Head"]), ("Head", "Single-source report.", "Head.", ["Head"]),
        ("Out report", "Reported by Out.", "Out report.", ["Out report"]), ("Source report", "Single-source report.", "Source report.", ["Source report"]),
    ]
    assert got[0]["topics"] == ["t"] and got[0]["entities"] == ["t", "g"] and got[0]["evidence"] == {"0": ["1"]} and len(got[0]["story_id"]) == 16
    items = [("r", k, f"s{k}", "O", f"h{k}", ("A", None, "B")[k % 3], [f"g{k % 2}"]) for k in range(20)]
    out = records.topic_stories(spark.createDataFrame(items, "by string, seq long, source_id string, outlet string, headline string, topic string, geographies array<string>"), "by", most=2).collect()
    by = {r["title"]: r for r in out}
    assert set(by) == {"A Updates", "General Updates"} and by["A Updates"]["source_ids"] == ["s0", "s3", "s6", "s9", "s12"]
    assert by["General Updates"]["summary"] == "General Updates. h1; h4; h7." and by["A Updates"]["geographies"] == ["g0", "g1"] and by["A Updates"]["evidence"]["4"] == ["s12"]


def test_delta_payload(spark):
    src = "story int, id string, seq long, outlet string, headline string, body array<string>"
    now = spark.createDataFrame([(1, "a", 0, "O", "New head", ["x"]), (1, "b", 1, "P", "B", ["y" * 500, "z"]), (1, "c", 2, "Q", "C", None), (2, "d", 0, "O", "D", [])], src)
    was = spark.createDataFrame([(1, "a", 0, "O", "Old head", ["x"]), (1, "e", 1, "O", " ", ["x"]), (2, "d", 0, "O", "D", [])], src)
    texts = spark.createDataFrame([(1, "t", "s", "m"), (2, "t", "s", "m")], "story int, title string, subtitle string, summary string")
    gate = changes.structural_gate(now, was, texts, texts)
    got = {r["story"]: r for r in changes.delta_payload(gate, now, was, excerpts=True).collect()}
    assert (got[1]["signal"], got[1]["added"], got[1]["removed"]) == ("strong", ["b", "c"], ["e"])
    assert [tuple(c) for c in got[1]["headline_changes"]] == [("a", "Old head", "New head")] and got[1]["excerpts"] == {"b": "y" * 400}
    assert got[1]["prior_headlines"] == ["Old head"] and got[1]["current_headlines"] == ["New head", "B", "C"]
    assert (got[2]["signal"], got[2]["added"], got[2]["headline_changes"], got[2]["excerpts"]) == ("none", [], [], {})
    assert all(r["excerpts"] == {} for r in changes.delta_payload(gate, now, was).collect())


def test_outlets_that_a_line_may_name(spark):
    rows = [("Scaffolding, says Reuters.", None), ("scaffolding", []), ("AFP and CNN", ["afp"]), ("in the New York Times", ["New York  Times"]), ("the nyt", ["New York Times"]), ("El País", ["El País"]), (None, ["x"]), ("rcn-news", [" "])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, o array<string>")
    got = [r["offending"] for r in changes.named_outlets(df, "t", "o").orderBy("i").collect()]
    assert got == ["reuters", None, "cnn", None, "nyt", None, None, "rcn"]


def test_vectors_are_made_once(spark, tmp_path):
    cache = VersionedTables(spark, f"file://{tmp_path}/c", {semantic.VECTORS: ["key"]})

    def embed(text):
        return F.array(F.length(text).cast("double"), F.lit(1.0))

    rows = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bbb"), (4, ""), (5, None)], "item long, t string")
    out, n = semantic.embedded(cache, rows, "t", embed, "m")
    assert n == 2 and {r["item"]: r["vector"] for r in out.collect()} == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: [3.0, 1.0], 4: None, 5: None}
    assert semantic.embedded(cache, rows, "t", embed, "m")[1] == 0
    more = rows.union(spark.createDataFrame([(6, "cccc")], "item long, t string"))
    assert semantic.embedded(cache, more, "t", embed, "m")[1] == 1 and semantic.embedded(cache, rows, "t", embed, "other")[1] == 2
    assert semantic.embedded(cache, rows.filter("item > 3"), "t", embed, "m")[1] == 0


@pytest.mark.parametrize("block", [3, 2048])
def test_nearest_items_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(semantic, "PROFILES", block)
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    same = vec()
    items = [(i, same if i % 7 == 0 else vec()) for i in range(200)] + [(900, [0.0] * 5), (901, None)]
    readers = [(f"r{i}", vec()) for i in range(8)] + [("none", None), ("zero", [0.0] * 5)]

    def score(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return round((sum(x * y for x, y in zip(a, b)) / (na * nb) + 1) / 2 if na and nb else 0.5, 9)

    want = {(r, rank, i) for r, b in readers if b for rank, (_, i) in enumerate(sorted((-score(v, b), i) for i, v in items if v)[:6], 1)}
    got = semantic.nearest(spark.createDataFrame(items, "item long, vector array<double>"), spark.createDataFrame(readers, "reader string, vector array<double>"), 6)
    assert {(r["reader"], r["rank"], r["item"]) for r in got.collect()} == want


def test_profiles_and_buckets(spark):
    a, none = lambda *x: F.array(*map(F.lit, x)), F.array().cast("array<string>")
    row = spark.range(1)
    texts = row.select(semantic.intent_text(a(" Tax ", ""), none, a("US", "Peru"), F.lit(" why ")), semantic.intent_text(none, a("k"), none, F.lit(None).cast("string")), semantic.intent_text(none, none, none, F.lit(" "))).first()
    assert tuple(texts) == ("Beat narrative: why I monitor news about Tax. Geographic focus: US, Peru.", "Specific topics I care about: k.", "")
    keys = row.select(semantic.profile_key(a("B", "a"), none, none, F.lit("n"), "m"), semantic.profile_key(a("A ", "b"), none, none, F.lit("n "), "m"), semantic.profile_key(a("A ", "b"), none, none, F.lit("n "), "other")).first()
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 40
    assert row.select(semantic.item_text(F.lit(" H "), F.lit(""), a("b1", "b2"), 9), semantic.recall_text(F.lit("O"), F.lit(None).cast("string"), a("b"))).first()[:] == ("H. b1 b2", "O — b")
    rows = spark.createDataFrame([("x", s) for s in (0.0, 0.19, 0.2, 0.99, 1.0, None, float("nan"))], "k string, s double")
    got = semantic.score_buckets(rows, ["k"], "s").first()
    assert [got[f"n{i}"] for i in range(5)] == [2, 1, 0, 0, 2] and round(got["mean"], 4) == 0.476
