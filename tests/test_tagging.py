"""Phrase automaton, tags and list hygiene against plain versions and real settings."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillstream.functions import phrases
from quillstream.functions.phrases import named_phrases, phrase_hits
from quillstream.operators.tagging import backed_keywords, canonical_topic, constrained_axis, evidence_text, extraction, story_tags, with_semantic_tags


def plain(text, own):
    """JavaScript's word boundaries, one pattern a phrase."""
    out = []
    for p in own:
        body, tail = (re.escape(p[:-1]), "") if p.endswith("*") else (re.escape(p), r"\b")
        if re.search(rf"\b{body}{tail}", text.lower(), re.ASCII):
            out.append(p)
    return out


def test_phrases_as_one_pattern_each(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["us", "use", "u.s.", "new york", "york", "é", "@who", "who", "a", "_", " ", ".", "-", "müller", "x1", "diploma", "tic"]
    own = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))).strip() for _ in range(120)} - {""} | {"diploma*", "us*"})
    texts = ["".join(rng.choice(parts + [" ", " "]) for _ in range(rng.randrange(14))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {i: None if t is None else plain(t, own) for i, t in enumerate(texts)}
    assert {r["i"]: r["p"] for r in df.select("i", named_phrases(spark, F.col("t"), own).alias("p")).collect()} == want
    monkeypatch.setattr(phrases, "BLOCK_CHARS", 60)  # many blocks, and many parts of a table
    assert {r["i"]: r["p"] and sorted(r["p"]) for r in df.select("i", named_phrases(spark, F.col("t"), own).alias("p")).collect()} == {i: p and sorted(p) for i, p in want.items()}
    hits = phrase_hits(df, "t", spark.createDataFrame([(f" {p.upper()}",) for p in own], "phrase string"), ["i"])
    assert sorted(map(tuple, hits.collect())) == sorted((i, p) for i, own_ in want.items() for p in own_ or ())


def test_story_tags(spark):
    settings = [("r", "topics", "Security policy"), ("r", "topics", "trade"), ("r", "keywords", "tariff"), ("r", "keywords", "Coca"), ("r", "geographies", "US"), ("r", "geographies", "China"), ("r", "geographies", "Peru"), ("q", "keywords", "tariff"), ("q", "topics", " ")]
    stories = [
        ("r", 1, "Tariffs and TRADE: talks in Beijing\nhttp://x/new-york", ["national security", None], ["peru"]),
        ("r", 2, "a tariff; nothing in Chinatown", None, None), ("q", 3, "The tariff", ["trade"], ["US"]), ("r", 4, None, [], []),
    ]
    got = story_tags(
        spark.createDataFrame(stories, "reader string, story int, evidence string, item_topics array<string>, item_geographies array<string>"),
        spark.createDataFrame(settings, "reader string, axis string, label string"),
    )
    assert {r["story"]: (r["topics"], r["keywords"], r["geographies"]) for r in got.collect()} == {1: (["Security policy", "trade"], [], ["China", "Peru"]), 2: ([], ["tariff"], []), 3: ([], ["tariff"], []), 4: ([], [], [])}
    scores = [("r", 1, "topics", "economy", 0.75), ("r", 1, "keywords", "duty", 0.74), ("r", 2, "keywords", "tariff", 0.9), ("r", 4, "geographies", "US", 0.9)]
    more = with_semantic_tags(got, spark.createDataFrame(scores, "reader string, story int, axis string, label string, score double"))
    assert {r["story"]: (r["topics"], r["keywords"], r["geographies"]) for r in more.collect()} == {1: (["economy", "Security policy", "trade"], [], ["China", "Peru"]), 2: ([], ["tariff"], []), 3: ([], ["tariff"], []), 4: ([], [], [])}


def test_places_of_a_short_name(spark):
    """"New York" and "Washington DC" stand for US as it is configured; a url counts as evidence."""
    rows = spark.createDataFrame([(1, "t", None, "s", [("Head in New York", ["b1", "b2"], "http://u/")])], "story int, title string, subtitle string, summary string, items array<struct<headline: string, body: array<string>, url: string>>")
    rows = rows.withColumn("evidence", evidence_text(*map(F.col, ("title", "subtitle", "summary", "items"))))
    assert rows.first()["evidence"] == "t\ns\nHead in New York\nb1 b2\nhttp://u/"
    rows = rows.selectExpr("'r' reader", "story", "evidence", "cast(null as array<string>) item_topics", "cast(null as array<string>) item_geographies")
    settings = spark.createDataFrame([("r", "geographies", "us"), ("r", "geographies", "Latin America")], "reader string, axis string, label string")
    assert story_tags(rows, settings).first()["geographies"] == ["us"]


def test_constrained_values(spark):
    rows = spark.createDataFrame([(["NATIONAL SECURITY", "x", "energy", "security policy", None], ["Energy policy", "Security policy"]), ([], ["a"]), (["B ", "a", "b"], ["a", "B"])], "v array<string>, s array<string>")
    assert [r[0] for r in rows.select(constrained_axis(F.col("v"), F.col("s"), topics=True)).collect()] == [["Security policy", "Energy policy"], [], ["B", "a"]]
    assert [r[0] for r in rows.select(constrained_axis(F.col("v"), F.col("s"))).collect()] == [["Security policy"], [], ["B", "a"]]
    text = spark.createDataFrame([("coca and TAX reform",)], "t string")
    assert text.select(backed_keywords(spark, F.col("t"), ["tax reform", "Coca", "cocaine", "Coca", " "])).first()[0] == ["tax reform", "Coca"]
    assert [r[0] for r in spark.createDataFrame([("Migration",), (" trade ",), ("ELECTION",), ("Energy",), ("Own",)], "t string").select(canonical_topic(F.col("t"))).collect()] == ["Migration policy", "Trade policy", "Elections", "Energy policy", "Own"]


def test_hygiene_of_extracted_lists(spark):
    draft = [
        ("no hints", ["compliance", "Energy", "sanctions", "Public health", "public health POLICY", "—", "x" * 65, "@who"], ["customs delays", "vaccine updates", "organized crime", "Shipping", "Bogotá", "中国", "OFAC", "ofac"], ["Colombia"], ["NYT", "WHO bulletins", "WHO", "the new york times", "Reuters"], ["@a.b", "@", "@!", "x@y", "@A.B", "@中国"]),
        ("@WHO says so", [], ["WHO"], [], [], []), ("who says so", [], [], [], [], []), (None, None, None, None, None, None),
    ]
    rows = spark.createDataFrame(draft, "text string, topics array<string>, keywords array<string>, geographies array<string>, traditional array<string>, social array<string>")
    got = [tuple(r)[1:] for r in extraction(rows).collect()]
    assert got[0] == (["Energy policy", "public health POLICY"], ["OFAC", "organized crime", "vaccine updates", "中国"][:2] + ["中国"], ["Colombia"], ["New York Times", "Reuters"], ["@a.b", "@中国"])
    assert got[1][1] == [] and got[2][1] == ["WHO"] and got[3] == ([], [], [], [], [])
