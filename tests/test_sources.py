"""Landed feeds, item files and the cache."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillstream.sources import items as src

AS_OF = "timestamp'2024-01-31 12:00:00'"


def test_dates_of_feeds(spark):
    dates = ["Wed, 31 Jan 2024 10:00:00 +0200", "31 Jan 2024 08:00:00 GMT", " Tue, 2 Jan 2024 08:00:00 +0000 ", "2024-01-31T08:00:00Z", "soon", "", None]
    rows = spark.createDataFrame([(d,) for d in dates], "d string")
    got = [r[0] for r in rows.select(F.date_format(src.published_at(F.col("d")), "dd HH:mm")).collect()]
    assert got == ["31 08:00", "31 08:00", "02 08:00", "31 08:00", None, None, None]


def test_feeds_that_may_be_read(spark, tmp_path):
    def feed(name, *entries):
        folder = tmp_path / "feeds" / f"feed_id={name}"
        folder.mkdir(parents=True)
        (folder / "rss.xml").write_text("<rss><channel>" + "".join(f"<item>{e}</item>" for e in entries) + "</channel></rss>")

    feed("a", "<title>One &amp; all</title><link>http://x/1</link><guid>g1</guid><pubDate>Wed, 31 Jan 2024 11:00:30 +0000</pubDate><description>&lt;p&gt;Body&lt;/p&gt; text</description>", "<title> </title><link>http://x/2</link>")
    for name in "bcde":
        feed(name, f"<title>{name}</title><link>http://x/{name}</link>")
    manifest = {"feeds": [
        {"id": "a", "name": "A", "kind": "rss", "url": "https://a", "publisher": "Pub", "weight": 7, "active": True}, {"id": "b", "name": "B", "kind": "rss", "url": "https://b"},
        {"id": "c", "kind": "video", "url": "https://c"}, {"id": "d", "kind": "rss", "url": "https://d", "active": False}, {"id": "e", "kind": "rss", "url": "ftp://e"},
    ]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    feeds = src.read_manifest(spark, str(tmp_path / "manifest.json"))
    assert {r["id"]: r["reason"] for r in src.feed_reasons(feeds).collect()} == {"a": None, "b": None, "c": "non_rss", "d": "inactive", "e": "invalid_url"}
    items = src.landed_items(spark, str(tmp_path / "feeds"), feeds, F.expr(AS_OF))
    got = {r["url"]: r for r in items.collect()}
    assert set(got) == {"http://x/1", "http://x/2", "http://x/b"}
    one = got["http://x/1"]
    assert (one["outlet"], one["weight"], one["minutes_ago"], one["headline"], one["body"]) == ("Pub", 7.0, 59.0, "One & all", ["Body text"])
    assert (got["http://x/2"]["headline"], got["http://x/2"]["body"], got["http://x/2"]["minutes_ago"]) == ("(untitled)", ["(untitled)"], 0.0)
    assert (got["http://x/b"]["outlet"], got["http://x/b"]["weight"]) == ("B", 50.0)
    only = spark.createDataFrame([("b",), ("c",)], "id string")
    assert [r["feed_id"] for r in src.landed_items(spark, str(tmp_path / "feeds"), feeds, F.expr(AS_OF), only).collect()] == ["b"]
    assert src.landed_items(spark, str(tmp_path / "feeds"), feeds, F.expr(AS_OF), only.limit(0)).count() == 3
    assert src.checked(items).filter("error is not null").count() == 0


def test_item_files_and_required_fields(spark, tmp_path):
    whole = {"source_id": "1", "feed_id": "f", "outlet": "o", "kind": "rss", "url": "u", "headline": "h", "body": ["b"], "minutes_ago": 3}
    (tmp_path / "items.json").write_text(json.dumps([whole, whole | {"url": " "}, {k: v for k, v in whole.items() if k != "body"}, whole | {"minutes_ago": None, "headline": ""}]))
    assert [r["error"] for r in src.checked(src.read_items(spark, str(tmp_path / "items.json"))).collect()] == [None, "missing url", "missing body", "missing headline"]
