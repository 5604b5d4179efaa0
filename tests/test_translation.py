"""Evidence that is translated once: segments, keys, failures and what stories are covered."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.operators import translation
from quillstream.sources.store import VersionedTables

ITEM = "source_id string, story int, lang string, headline string, body array<string>"


def plain_segments(headline, body, most=20, snippets=2):
    parts = [(headline or "").strip(), *[x.strip() for x in body or [] if x and x.strip()][:snippets]]
    out, used = [], 0
    for p in parts:
        if used >= most:
            break
        out.append(p[: most - used])
        used += len(out[-1])
    return out or [""]


def test_segments(spark):
    cases = [("head", ["one", " ", None, " two ", "three"]), ("h" * 30, ["x"]), ("h" * 20, ["x"]), ("h" * 18, ["abc", "d"]), ("", ["x" * 25, "y"]), (None, None), (" a ", [])]
    rows = spark.createDataFrame(cases, "h string, b array<string>")
    assert [r[0] for r in rows.select(translation.evidence_segments(F.col("h"), F.col("b"), 20, 2)).collect()] == [plain_segments(*c) for c in cases]


def test_each_evidence_is_translated_once_and_failures_stay_open(spark, tmp_path):
    cache = VersionedTables(spark, f"file://{tmp_path}/c", {translation.TRANSLATIONS: ["key"]})
    rows = spark.createDataFrame([("a", 1, "es", "hola", ["uno", "dos", "tres"]), ("b", 1, "EN-us", "hi", ["x"]), ("c", 1, " fr ", "bonjour", None), ("d", 2, "de", "hallo", ["y"]), ("e", 2, None, "?", None), ("a", 1, "es", "hola", ["uno", "dos", "tres"])], ITEM)

    def shout(segments, lang):  # French comes back short, German not at all
        return F.when(lang == "fr", F.array().cast("array<string>")).when(lang != "de", F.transform(segments, lambda s: F.concat(F.upper(s), F.lit(" "))))

    first = translation.translated_items(cache, rows, shout)
    got = {r["source_id"]: r for r in first.collect()}
    assert first.count() == 6 and (got["a"]["normalized_headline"], got["a"]["normalized_body"]) == ("HOLA", ["UNO", "DOS"])
    assert got["a"]["translation"][:5] == (True, True, False, False, None) and got["b"]["translation"][:5] == (False, False, False, False, None)
    assert got["c"]["translation"][:5] == got["d"]["translation"][:5] == (True, False, True, False, "error") and got["d"]["normalized_headline"] is None
    assert {r["story"]: (r["sources"], r["covered"], r["needed"], r["translated"], r["degraded"]) for r in translation.story_coverage(first).collect()} == {1: (4, 3, 3, 2, False), 2: (2, 1, 1, 0, True)}
    again = translation.translated_items(cache, rows, shout)
    assert tuple(translation.translation_report(again).first()) == (6, 4, 2, 2, 2, 0.5)
    said = again.select("source_id", translation.english_headline(F.col("normalized_headline"), F.col("headline")), translation.english_body(F.col("normalized_body"), F.col("body"))).collect()
    assert {tuple(map(str, r)) for r in said if r[0] in "ad"} == {("a", "HOLA", "['UNO', 'DOS']"), ("d", "hallo", "['y']")}


def test_without_a_translator(spark, tmp_path):
    cache = VersionedTables(spark, f"file://{tmp_path}/c", {translation.TRANSLATIONS: ["key"]})
    rows = spark.createDataFrame([("a", 1, "es", "hola", ["x"]), ("b", 1, "en", "hi", [])], ITEM)
    reason = lambda df: {r["source_id"]: r["translation"]["reason"] for r in df.collect()}
    assert reason(translation.translated_items(cache, rows, None)) == {"a": "no_translate_fn", "b": None}
    assert reason(translation.translated_items(cache, rows, lambda s, _: s, enabled=False)) == {"a": "stage_disabled", "b": "stage_disabled"}
    none = translation.translated_items(cache, rows.limit(0), lambda s, _: s)
    assert none.count() == 0 and tuple(translation.translation_report(none).first()) == (0, 0, 0, 0, 0, 0.0)
