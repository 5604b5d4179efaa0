"""Roll-ups, item joins and lists on few rows: nulls, empty tables, ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.operators import reports


def test_empty_eval_gives_a_total_of_none(spark):
    cases = spark.createDataFrame([], "group string, pass boolean, hard_fail boolean, fallback boolean, fail_reasons array<string>, label_mismatches array<string>")
    rows = reports.eval_rollup(cases)
    assert [(r["group"], r["total"], r["passed_rate"]) for r in rows.collect()] == [(None, 0, 0.0)]
    assert reports.eval_gate(rows).first()["blockers"] == ["overall_pass_rate"]


def test_funnel_passes_over_stages_that_did_not_run(spark):
    items = spark.createDataFrame([("social", 0), ("social", 1), ("social", 3), ("social", 3), ("traditional", 3), (None, 3)], "kind string, reached int")
    rows = reports.social_funnel(items, ["a", "b", "c", "d"], not_run=["c"]).collect()
    assert [tuple(r) for r in rows] == [("a", 4, None, False), ("b", 3, 1, True), ("c", None, None, False), ("d", 2, None, False)]
    assert not any(r["primary"] for r in reports.social_funnel(items.filter("false"), ["a", "b"]).collect())


def test_translations_and_protected_items(spark):
    items = spark.createDataFrame([(1, "de", "x", 1), (2, " EN-us", "y", 1), (3, None, None, 2), (4, "fr", "z", 2)], "source_id int, lang string, text string, lane int")
    new = spark.createDataFrame([(1, None)], "source_id int, text string")
    got = {r["source_id"]: (r["text"], r["needed"], r["applied"], r["reason"]) for r in reports.with_translations(items, new).collect()}
    assert got == {1: (None, True, True, None), 2: ("y", False, False, None), 3: (None, False, False, None), 4: ("z", True, False, "cold_start_cap")}
    recalled = items.filter("source_id in (1, 4)")
    assert sorted(r[0] for r in reports.with_protected(recalled, items).collect()) == [1, 2, 4]
    assert reports.with_protected(recalled, items, degraded=True) is recalled


def test_merged_social_keeps_rows_without_id(spark):
    cached = spark.createDataFrame([("a", 2), ("", 3), (None, 4)], "source_id string, n int")
    live = spark.createDataFrame([("a", 1), ("b", 5), ("", 6)], "source_id string, n int")
    assert sorted(r["n"] for r in reports.merged_social(cached, live, [F.col("n")]).collect()) == [2, 3, 4, 5, 6]


def test_lists_and_names(spark):
    row = spark.createDataFrame([([" Oil ", "oil", "--", None, "@x", "a" * 65, "中国"], "@A, @@a,,b ", ["@ok", "@!", "@a b", "x"])], "v array<string>, raw string, h array<string>")
    got = row.select(reports.hygiene(F.col("v")).alias("v"), reports.usernames(F.col("raw")).alias("u"), reports.hygiene(F.col("h"), handles=True).alias("h"), reports.usernames(F.lit(None).cast("string")).alias("none")).first()
    assert (got["v"], got["u"], got["h"], got["none"]) == (["Oil", "中国"], ["a", "b"], ["@ok"], [])
