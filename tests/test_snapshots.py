"""The versioned store under killed and concurrent writes, and snapshots of earlier contracts."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillstream.operators import snapshots
from quillstream.sources.store import ConcurrentCommit, VersionedTables


@pytest.fixture()
def own(spark, tmp_path):
    return VersionedTables(spark, f"file://{tmp_path}/store", {"a": ["k"], "b": ["k"]})


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k int, v string")


def seen(own, table="a", number=None):
    out = own.read(table, number)
    return None if out is None else sorted(map(tuple, out.collect()))


def test_readers_never_see_half_a_commit(spark, own, tmp_path, monkeypatch):
    assert seen(own) is None and own.current()[0] == 0
    own.commit({"a": rows(spark, (1, "x"), (2, "y"))})

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(own, "_publish", killed)  # the data is written, the manifest is not
    with pytest.raises(KeyboardInterrupt):
        own.commit({"a": rows(spark, (1, "lost")), "b": rows(spark, (1, "lost"))})
    monkeypatch.undo()
    assert seen(own) == [(1, "x"), (2, "y")] and seen(own, "b") is None
    (tmp_path / "store" / "manifests" / f"{2:012d}.json").write_text('{"tables": {"a": [{"fol')  # a writer stopped in the middle of its manifest
    assert seen(own) == [(1, "x"), (2, "y")] and own.current()[0] == 1
    assert own.commit({"a": rows(spark, (2, "z"), (3, None)), "b": rows(spark, (9, "b"))}) == 3
    assert seen(own) == [(1, "x"), (2, "z"), (3, None)] and seen(own, "b") == [(9, "b")] and seen(own, "a", 1) == [(1, "x"), (2, "y")]
    with pytest.raises(KeyError):
        own.commit({"c": rows(spark)})


def test_a_commit_after_an_unseen_one_is_refused(spark, own):
    own.commit({"a": rows(spark, (1, "x"))})
    base, manifest = own.current()
    own.commit({"a": rows(spark, (1, "other"))})
    with pytest.raises(ConcurrentCommit):
        own._publish(base, manifest)
    assert seen(own) == [(1, "other")]


def test_labels_compaction_and_vacuum(spark, own, tmp_path):
    for k in range(4):
        own.commit({"a": rows(spark, (k % 2, f"v{k}"))}, f"batch {k}")
    assert own.commit({"a": rows(spark, (0, "again"))}, "batch 3") == own.current()[0]
    before = own.current()[0]
    assert own.compact() == before + 1 and len(own.current()[1]["tables"]["a"]) == 1
    assert own.compact() == before + 1  # nothing to do
    assert seen(own) == [(0, "v2"), (1, "v3")] == seen(own, "a", before)
    assert own.vacuum() == 4 and seen(own) == [(0, "v2"), (1, "v3")]
    assert own.commit({"a": rows(spark, (0, "again"))}, "batch 3") == before + 1
    own.commit({"a": rows(spark, (5, "p"), (5, "q"))})  # of one key in one commit, one row
    assert seen(own) == [(0, "v2"), (1, "v3"), (5, "q")]


def test_snapshots_of_earlier_contracts(spark):
    old = {
        "contractVersion": "2026-04-22-slice1", "_everSeenMetaStoryIds": ["m1"], "_lastRunMeta": {"funnel": {"in": 3}, "clusterModel": "x", "other": 1},
        "stories": [
            {"metaStoryId": "1", "takeaway": "t", "tags": {"topics": ["a", None]}, "sources": [{"sourceId": "s", "kind": "rss", "weight": 3}, {"kind": "social"}]},
            {"metaStoryId": "2", "takeaway": "t", "subtitle": "own"}, {"metaStoryId": "3", "subtitle": ""},
        ],
    }
    payloads = [("u", json.dumps(old)), ("v", json.dumps({"contractVersion": "2026-05-19-meta-story-fields", "stories": None, "_lastCheckedAt": "2024-01-01T00:00:00Z"})), ("w", "no json"), ("x", json.dumps({"contractVersion": "9"})), ("y", None)]
    rows_ = spark.createDataFrame([(u, p, dt.datetime(2024, 1, 2)) for u, p in payloads], "user_id string, payload string, refreshed_at timestamp")
    got = {r["user_id"]: r for r in snapshots.loaded(rows_).collect()}
    u = got["u"]
    assert u["contract_version"] == "2026-05-19-meta-story-fields" == got["v"]["contract_version"]
    assert [s["subtitle"] for s in u["stories"]] == ["t", "own", ""] and "takeaway" not in u["stories"][0].asDict()
    assert u["stories"][0]["tags"].asDict() == {"topics": ["a"], "keywords": [], "geographies": []} and u["stories"][1]["sources"] == []
    assert [x["kind"] for x in u["stories"][0]["sources"]] == ["traditional", "social"]
    assert u["ever_seen"] == ["m1"] and u["report"] == {"funnel": '{"in":3}', "clusterModel": "x"} and u["last_checked_at"] is None
    assert got["v"]["last_checked_at"] == "2024-01-01T00:00:00Z" and got["v"]["stories"] == []
    assert got["x"]["contract_version"] == "9" and got["w"]["contract_version"] is None is got["y"]["contract_version"] and got["y"]["stories"] == []


def test_a_look_changes_nothing_else(spark):
    payloads = [("u", '{"stories":[1]}'), ("v", '{"_lastCheckedAt": "old", "a": "x\\\\$1"}'), ("w", " {} ")]
    rows_ = spark.createDataFrame([(u, p, dt.datetime(2024, 1, 2)) for u, p in payloads], "user_id string, payload string, refreshed_at timestamp")
    checked = spark.createDataFrame([(u, dt.datetime(2024, 3, 4, 5, 6, 7)) for u in "uvwz"], "user_id string, at timestamp")
    got = {r["user_id"]: r for r in snapshots.touched(rows_, checked).collect()}
    assert {u: json.loads(r["payload"]) for u, r in got.items()} == {"u": {"stories": [1], "_lastCheckedAt": "2024-03-04T05:06:07Z"}, "v": {"_lastCheckedAt": "2024-03-04T05:06:07Z", "a": "x\\$1"}, "w": {"_lastCheckedAt": "2024-03-04T05:06:07Z"}}
    assert got["u"]["refreshed_at"] == dt.datetime(2024, 1, 2)


def test_settings(spark):
    rows_ = spark.createDataFrame([("u", '{"contractVersion": "old", "topics": ["a"], "n": 1}', "new"), ("v", None, "new"), ("w", '{"x": "y"}', None)], "user_id string, data string, contract_version string")
    got = {r["user_id"]: r["settings"] for r in snapshots.merged_settings(rows_).collect()}
    assert got == {"u": {"contractVersion": "new", "topics": '["a"]', "n": "1"}, "v": {"contractVersion": "new"}, "w": {"x": "y"}}
    lists = [("u", ["Colombia", "Bogotá", "tax", "moscow"], ["colombia"]), ("v", ["tax"], ["Peru"]), ("w", None, ["Peru"]), ("x", ["USA", "united states", "Washington", "trade"], ["US"]), ("y", ["Peru"], [])]
    changed = snapshots.backfilled(spark.createDataFrame(lists, "user_id string, keywords array<string>, geographies array<string>"))
    assert {r["user_id"]: r["keywords"] for r in changed.collect()} == {"u": ["tax", "moscow"], "x": ["trade"]}
    own = [("u", 1, "a"), ("u", 2, "b"), ("v", 1, "c")]
    current = snapshots.current_narratives(spark.createDataFrame(own, "user_id string, submitted_at int, raw_text string")).filter(F.col("is_current"))
    assert sorted(r["raw_text"] for r in current.collect()) == ["b", "c"]
