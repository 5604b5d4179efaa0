"""Landed pages and due runs as streams: a restart, a replay and late files give what the batch gives."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillstream.sources import social
from quillstream.streaming import feeds, runs


def land(folder, name, number, posts, follows=None):
    page = folder / f"username={name}" / f"page={number}"
    page.mkdir(parents=True)
    (page / "part-0.txt").write_text(json.dumps({"posts": posts, "next": follows}))


def post(i, at="2024-03-01T12:00:00Z", text=None, lang=None):
    return {"id": i, "text": f"post {i}" if text is None else text, "created_at": at, "lang": lang}


def test_timelines_stop_behind_the_bound(spark, tmp_path):
    land(tmp_path, "a", 0, [post(1, "2024-03-02T01:00:00Z"), post(2, "2024-03-01T01:00:00Z")], 1)
    land(tmp_path, "a", 1, [post(3, "2024-02-28T01:00:00Z")], 2)
    land(tmp_path, "a", 2, [post(4, "2024-02-27T01:00:00Z")])
    land(tmp_path, "b", 0, [post(5, "no time")], 1)
    land(tmp_path, "b", 1, [post(6)], 0)  # a cursor that goes in a circle
    land(tmp_path, "c", 0, [post(7)], 9)  # a page that is not there
    path = str(tmp_path)
    ids = lambda df: sorted(r["post_id"] for r in df.filter("error is null").collect())
    assert ids(social.read_posts(spark, path)) == ["1", "2", "3", "4", "5", "6", "7"]
    assert ids(social.read_posts(spark, path, since="2024-03-01T00:00:00Z")) == ["1", "2", "3", "5", "6", "7"]
    assert ids(social.read_posts(spark, path, "@A, a, @b", allowed="B")) == ["5", "6"]
    assert social.read_posts(spark, path, "a", allowed="x").count() == 0
    report = {r["username"]: (r["n_posts"], (r["error"] or "").split(":")[0]) for r in social.page_report(social.read_posts(spark, path, "a,c,d")).collect()}
    assert report == {"a": (4, ""), "c": (1, "FileNotFoundError"), "d": (0, "FileNotFoundError")}


def test_a_bound_in_the_query_reaches_the_source(spark, tmp_path):
    for k in range(4):
        land(tmp_path, "a", k, [post(k, f"2024-03-0{9 - k}T00:00:00Z")], k + 1 if k < 3 else None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = social.read_posts(spark, str(tmp_path)).filter(F.col("created_at") >= F.lit("2024-03-08 00:00:00").cast("timestamp"))
        assert sorted(r["page"] for r in df.collect()) == [0, 1]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = social._PushedTimelines({"path": str(tmp_path)})
    list(reader.pushFilters([social.GreaterThanOrEqual(("created_at",), dt.datetime(2024, 3, 8, tzinfo=dt.UTC)), social.GreaterThan(("page",), 0)]))
    assert [r[1] for r in reader.read(social._Name("a"))] == [0, 1, 2]  # the third reaches behind the bound


def test_posts_as_items(spark, tmp_path):
    land(tmp_path, "a", 0, [post(1, text=" Hello "), post(None, text="no id"), post(2, text="", lang="es"), post(None, text=" "), post(1, text="again")])
    as_of = F.lit("2024-03-01 13:01:30").cast("timestamp")
    got = {r["url"]: r for r in social.posts_as_items(social.read_posts(spark, str(tmp_path)), as_of).collect()}
    assert sorted(r["headline"] for r in got.values()) == ["(untitled)", "Hello", "no id"]
    hello = got["https://x.com/a/status/1"]
    assert (hello["feed_id"], hello["outlet"], hello["kind"], hello["weight"], hello["minutes_ago"], hello["body"]) == ("x:a", "@a", "social", 60.0, 61.0, ["Hello"])
    assert hello["source_id"].startswith("x:a:") and got["https://x.com/a/status/2"]["lang"] == "es"


def test_stream_of_pages_gives_each_post_once_over_a_restart(spark, tmp_path):
    pages, out, progress = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "progress")
    take = lambda: feeds.run_once(social.stream_posts(spark, str(pages)), "append", feeds.appended_into(out), progress)
    have = lambda: sorted((r["username"], r["post_id"]) for r in spark.read.parquet(out).collect())
    land(pages, "a", 0, [post(1), post(2)])
    land(pages, "b", 0, [post(3)])
    take()
    assert have() == [("a", "1"), ("a", "2"), ("b", "3")]
    land(pages, "a", 1, [post(4)])
    land(pages, "c", 0, [post(5)])
    take()
    take()
    assert have() == [("a", "1"), ("a", "2"), ("a", "4"), ("b", "3"), ("c", "5")]


def at(hours, minutes=0):
    return dt.datetime(2024, 3, 1, tzinfo=dt.UTC) + dt.timedelta(hours=hours, minutes=minutes)


@pytest.mark.parametrize("batches", [[[0, 1, 2, 3, 4, 5, 6]], [[0, 1], [2, 3], [4], [5, 6]]])
def test_due_runs_are_alike_however_the_signs_come(spark, tmp_path, batches):
    signs = [("u", at(0), "x"), ("u", at(3), "x"), ("u", at(13), "y"), ("v", at(14), None), ("u", at(18), "z"), ("w", at(30), "q"), ("v", at(50), None)]
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    schema = "user string, at timestamp, fingerprint string"
    for k, own in enumerate(batches):
        spark.createDataFrame([signs[i] for i in own], schema).coalesce(1).write.parquet(f"{source}/n={k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))  # a restart for each
        feeds.run_once(runs.due_runs(stream, 360, "1 hour"), "append", feeds.appended_into(out), progress)
    got = spark.read.parquet(out)
    rows = sorted((r["user"], r["at"].replace(tzinfo=dt.UTC), r["action"]) for r in got.collect())
    # the last watermark is 49 h: u has due times up to 48 h; y came at 13 h, z at 18 h, itself a due time
    want_u = [(0, "run"), (6, "unchanged"), (12, "unchanged"), (18, "run"), *((h, "unchanged") for h in (24, 30, 36, 42, 48))]
    assert [(r[1], r[2]) for r in rows if r[0] == "u"] == [(at(h), a) for h, a in want_u]
    assert [(r[1], r[2]) for r in rows if r[0] == "v"] == [(at(h), "run") for h in (14, 20, 26, 32, 38, 44)]  # no fingerprint: never unchanged
    assert [(r[1], r[2]) for r in rows if r[0] == "w"] == [(at(30), "run"), *((at(h), "unchanged") for h in (36, 42, 48))]
    assert {r["action"]: (r["n"], r["users"]) for r in runs.run_summary(got).collect()} == {"run": (9, 3), "unchanged": (10, 2)}


def test_fingerprints(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("", ""), (None, None), ("a", None)], "a string, b string")
    assert [r[0] for r in rows.select(runs.unchanged(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]
