"""Operators whose cases the test tables do not hold: live and url merges, claims in order, labels, entities."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.operators import clusters, dedupe, selection, stories
from quillstream.plans import profile

ITEM = "seq long, source_id string, feed_id string, outlet string, headline string, body array<string>, minutes_ago double, weight double, url string"


def _items(spark, rows):
    return spark.createDataFrame([(i, f"s{i}", "f", o, h, [b], float(m), 1.0, u) for i, (o, h, b, m, u) in enumerate(rows)], ITEM)


@pytest.mark.parametrize(("ages", "groups"), [([0, 50, 100], [[0, 1], [2]]), ([0, 70, 80], [[0], [1, 2]])])
def test_url_windows_do_not_chain(spark, ages, groups):
    rows = _items(spark, [("o", "Same words", "b" * i, m, "http://h.org/a?utm_x=1") for i, m in enumerate(ages)])
    out = dedupe.dedupe_items(rows).collect()
    assert sorted(sorted([int(r["source_id"][1:]), *(int(d["source_id"][1:]) for d in r["duplicates"])]) for r in out) == groups
    assert all(d["url"] == "http://h.org/a?utm_x=1" for r in out for d in r["duplicates"])


def test_live_blogs_merge_by_publisher_and_subject(spark):
    rows = _items(spark, [
        ("A", "Live updates: the vote", "long body", 30, "http://a.org/1"), ("A", "live blog: The Vote!", "b", 5, "http://a.org/2"), ("B", "Live updates: the vote", "b", 5, "http://b.org/1"),
        ("A", "Live updates: the vote", "b", 500, "http://a.org/3"),
    ])
    got = {r["source_id"]: r["n_duplicates"] for r in dedupe.dedupe_items(rows).collect()}
    assert got == {"s1": 1, "s2": 0, "s3": 0}  # the freshest wins; another publisher and a later window stand alone


def test_items_without_a_headline_merge_by_source(spark):
    rows = _items(spark, [("o", "!!", "b", 1, None), ("o", None, "b", 2, None), ("o", None, "bb", 3, None)]).withColumn("source_id", F.expr("if(seq = 2, 's1', source_id)"))
    assert {r["source_id"]: r["n_duplicates"] for r in dedupe.dedupe_items(rows).collect()} == {"s0": 0, "s1": 1}


@pytest.mark.parametrize("tail", [0, 50_000])
def test_claims_are_taken_in_order(spark, monkeypatch, tail):
    monkeypatch.setattr(stories, "TAIL_ROWS", tail)  # in rounds, and on the driver
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(40), 100 + rng.randrange(30)) for _ in range(60)})
    taken, want = set(), []
    for story in sorted({s for s, _ in pairs}):
        free = [p for s, p in pairs if s == story and p not in taken]
        if len(free) == 1:
            taken.add(free[0])
            want.append((story, free[0]))
    got = stories.claim_lineage(spark.createDataFrame(pairs, "story long, prior long"))
    assert sorted(map(tuple, got.collect())) == want


def test_a_chain_of_claims_longer_than_any_number_of_rounds(spark):
    """Story k may go on with prior k or k + 1: the first takes none, as both are free, and so does every other."""
    pairs = [(k, p) for k in range(3000) for p in (k, k + 1)] + [(-1, 0)]
    got = stories.claim_lineage(spark.createDataFrame(pairs, "story long, prior long"))
    assert sorted(map(tuple, got.collect())) == [(k, k + 1) for k in range(-1, 3000)]


def test_similar_sets_against_all_pairs(spark):
    rng = random.Random(2)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 7))} for i in range(60)}
    rows = spark.createDataFrame([(i, i % 2, t) for i, s in sets.items() for t in s], "id long, kind long, token long")
    for least in (0.15, 0.5, 1.0):
        got = sorted((r["a"], r["b"]) for r in stories.similar_sets(rows, rows, ["kind"], least).filter("a < b").collect())
        assert got == sorted((a, b) for a in sets for b in sets if a < b and a % 2 == b % 2 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)


def test_links_hold_together_what_similar_pairs_do(spark):
    """One star for all copies, every link between sets that differ, in large groups and in small ones."""
    rng = random.Random(5)
    sets = {i: {f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 9))} for i in range(150)} | {i: {"x", "y", "z"} for i in range(150, 420)} | {420: {"x"}, 421: {"x"}, 422: set()}
    kind = {i: i % 4 if i < 20 else 9 for i in sets}
    rows = spark.createDataFrame([(kind[i], i, sorted(s)) for i, s in sets.items()], "kind long, id long, s array<string>")
    for least, shared in ((0.15, 1), (0.34, 2), (1.0, 1)):
        links = [tuple(r) for r in stories.similar_links(rows, "kind", least, shared).select("a", "b", "kind").collect()]
        pairs = {(a, b) for a in sets for b in sets if a < b and kind[a] == kind[b] and len(sets[a] & sets[b]) >= shared and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert len(set(links)) == len(links) < 12000 and {(a, b) for a, b, _ in links} <= pairs and all(kind[a] == k for a, _, k in links)
        root = {i: i for i in sets}

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b, _ in links:
            root[max(top(a), top(b))] = min(top(a), top(b))  # noqa: B023
        assert all(top(a) == top(b) for a, b in pairs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(20)] + [(2, 5, 3)], "story long, a long, b long")
    got = {(r["story"], r["id"]): r["root"] for r in clusters.components(edges, "story").collect()}
    assert got == {(1, i): 0 for i in range(21)} | {(2, 3): 3, (2, 5): 3}


@pytest.mark.parametrize(("html", "plain"), [("<p>a&#233;&#x263A;b</p>", "aé☺b"), ("&#xD800;x&#1114112;y", "xy"), ("&amp;#65; &lt;b&gt;", "&#65; <b>"), (None, "")])
def test_numeric_references(spark, html, plain):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(text.strip_html(F.col("h")).alias("x")).first()["x"] == plain


@pytest.mark.parametrize(
    ("said", "terms", "found"),
    [
        ("Votes in U.S. states", ["u.s."], False), ("the U.S.x", ["U.S."], True), ("Elección hoy", ["elección"], True), ("preelection", ["election"], False), ("a second round b", ["second round"], True),
        ("x_election", ["election"], False), ("élection", ["lection"], True), ("", ["x"], False), (None, ["x"], False), ("anything", [], False), ("CAMPAÑA", ["campaña"], True),
    ],
)
def test_mentions_are_whole_ascii_words(spark, said, terms, found):
    assert spark.createDataFrame([(said,)], "t string").select(text.mentions(F.col("t"), terms).alias("x")).first()["x"] is found


def test_lexicon_people_and_places(spark):
    settings = profile.Settings(("Migration",), ("vote",), ("Colombia",))
    rows = spark.createDataFrame([(0, "Los inmigrantes y el voto"), (1, "Colombian farmers"), (2, "News from Medellín"), (3, "Migrants at the ballots")], "i long, text string")
    got = rows.select("i", *(c.alias(n) for n, c in profile.recall_flags(F.col("text"), settings).items()), profile.recalled(F.col("text"), settings).alias("any")).orderBy("i").collect()
    assert [(r["by_topic"], r["by_keyword"], r["by_geo"], r["any"]) for r in got] == [(False, False, False, False), (False, False, True, True), (False, False, True, True), (True, False, False, True)]


def test_labels(spark):
    row = spark.createDataFrame([("The Washington Post — Politics", "@Some_One", "bad handle!", "The Daily - World")], "a string, b string, c string, d string").select(
        selection.matching_name(F.col("a")).alias("a"), selection.social_handle(F.col("b")).alias("b"), selection.social_handle(F.col("c")).alias("c"), selection.publisher(F.col("d")).alias("d"),
        selection.constrained(F.array(F.lit("b"), F.lit(" A "), F.lit("z"), F.lit("B")), F.array(F.lit("A"), F.lit("B"))).alias("e"), selection.aliased_name(F.lit("NYT")).alias("f"),
    ).first()
    assert tuple(row) == ("washington post politics", "@some_one", "", "The Daily", ["B", "A"], "new york times")
