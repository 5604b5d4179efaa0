"""Splitting over-merged clusters and merging stories of one event, with the words of elections and real places."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstream.functions.text import evidence_tokens, geography_of, geography_words, places_of, theme_words
from quillstream.operators.bundles import merge_bundles
from quillstream.operators.clusters import split_clusters

STORIES = "reader string, place long, story_id string, deferred boolean, title string, subtitle string, summary string, source_ids array<string>, claims array<string>, evidence map<string, array<string>>, topics array<string>, keywords array<string>, geographies array<string>, entities array<string>"


def test_words():
    words = theme_words()
    assert {"segunda", "vuelta", "debate", "electorate", "comicios", "encuesta", "vote", "tarjetón"} <= set(words)
    assert not {"second", "round", "the"} & set(words)
    assert {"colombia", "bogotá", "medellín", "cali", "colombian"} <= set(geography_words(["colombia"]))
    assert {"york", "states", "usa", "washington"} <= set(geography_words(["us"])) and "lima" not in geography_words(["us"])
    assert places_of(["US"])["new york"] == "US" and geography_words([]) == ()


def test_geography_of(spark):
    rows = spark.createDataFrame([(" Bogotá ",), ("New York",), ("Lima",), (None,)], "p string")
    assert [r[0] for r in rows.select(geography_of(F.col("p"), ["US", "Colombia"])).collect()] == ["Colombia", "US", None, None]
    assert [r[0] for r in rows.select(geography_of(F.col("p"), [])).collect()] == [None] * 4


def split(spark, heads, claims=()):
    stops = geography_words(["Colombia"])
    items = spark.createDataFrame([(1, str(i), True, h) for i, h in enumerate(heads)], "story int, id string, english boolean, head string").withColumn("tokens", evidence_tokens(F.col("head"), stops)).drop("head")
    out = split_clusters(items, spark.createDataFrame(list(claims), "story int, claim int, source_id string"))
    return sorted((tuple(r["ids"]), r["action"], r["reason"]) for r in out.collect())


def test_a_shared_country_does_not_hold_a_cluster_together(spark):
    """Two sources that share a word of elections stay together, the attack goes; names of the country count for nothing."""
    got = split(spark, ["Colombia debate draws millions of viewers", "Bogotá hosts final televised debate", "Colombia mine attack kills soldiers"])
    assert got == [(("0", "1"), "split", "low_token_overlap"), (("2",), "split", "low_token_overlap")]
    assert split(spark, ["Segunda parte del informe", "Vuelta a Colombia arranca hoy"]) == [(("0",), "split", "low_token_overlap"), (("1",), "split", "low_token_overlap")]
    assert split(spark, ["Candidates trade barbs", "Ballot count begins"], [(1, 0, "0"), (1, 0, "1")]) == [(("0", "1"), "kept", None)]
    assert split(spark, ["Peace talks resume in Havana", "Peace talks resume in Havana today"]) == [(("0", "1"), "kept", None)]


def rows_of(spark, stories, heads, geographies=("Colombia",)):
    def row(s):
        reader, place, story_id, deferred, title, ids, own = s
        return (reader, place, story_id, deferred, title, own.get("subtitle"), own.get("summary", ""), ids, own.get("claims", [f"claim {i}" for i in ids]), own.get("evidence", {str(k): [i] for k, i in enumerate(ids)}), *(own.get(a, []) for a in ("topics", "keywords", "geographies", "entities")))

    items = spark.createDataFrame([(i, h, b) for i, h, b in heads], "source_id string, headline string, body array<string>")
    return {r["place"]: r for r in merge_bundles(spark.createDataFrame([row(s) for s in stories], STORIES), items, "reader", list(geographies)).collect()}


HEADS = [
    ("a", "Colombia presidential race: Cepeda and Espriella clash over tax reform", ["x"]),
    ("b", "Cepeda, Espriella spar on tax reform in Bogotá debate", ["y"]),
    ("c", "Peru election: Cepeda and Espriella clash over tax reform", ["Lima"]),
    ("d", "Colombia election turnout reaches a record", ["z"]),
    ("e", "Cepeda and Espriella clash over tax reform", ["Colombia votes", "and", "more"]),
    ("f", "Colombia tax reform: Cepeda and Espriella clash", ["No word of it here"]),
]


def test_merge_of_one_event(spark):
    s = [
        ("r", 0, "s0", False, " ", ["a"], {"topics": ["Elections"], "claims": ["A"], "keywords": ["tax", "reform"], "entities": ["Cepeda"], "summary": "first"}),
        ("r", 1, "s1", False, "C", ["c"], {}),
        ("r", 2, "s2", False, "B", ["b", "d"], {"topics": ["Politics", "Elections"], "claims": ["B0", "B1", "B2"], "evidence": {"0": ["b"], "1": ["gone"], "2": ["d", "", "a"]}, "keywords": ["reform", "vote"], "subtitle": "sub"}),
        ("r", 3, "s3", True, "E", ["e"], {}),
        ("r", 4, "s4", False, "F", ["f"], {}),
        ("q", 5, "s5", False, "A", ["a"], {}),
        ("r", 6, "s6", False, "E", ["e"], {}),
    ]
    got = rows_of(spark, s, HEADS)
    assert sorted((p, r["n_merged"]) for p, r in got.items()) == [(0, 3), (1, 1), (3, 1), (4, 1), (5, 1)]
    m = got[0]
    # s2 has most sources and gives title and subtitle; its summary is blank, so the claims are joined
    assert (m["title"], m["subtitle"], m["summary"]) == ("B", "sub", "A. B0. B2. claim e")
    assert m["source_ids"] == ["a", "b", "d", "e"] and m["claims"] == ["A", "B0", "B2", "claim e"]
    assert m["evidence"] == {"0": ["a"], "1": ["b"], "2": ["d", "a"], "3": ["e"]}
    assert (m["topics"], m["keywords"], m["entities"]) == (["Elections", "Politics"], ["tax", "reform", "vote"], ["Cepeda"])
    assert len(m["story_id"]) == 16 and got[1]["story_id"] == "s1" and got[1]["subtitle"] is None


def test_other_facets_and_no_places_stay_apart(spark):
    s = [("r", i, f"s{i}", False, "t", [x], {}) for i, x in enumerate("abde")]
    assert len(rows_of(spark, s, HEADS, ())) == 4
    facets = [("a", "Colombia election debate tonight", ["x"]), ("b", "Colombia election ballot count starts", ["x"]), ("d", "Colombia election turnout", ["x"]), ("e", "Colombia debate count", ["x"])]
    assert len(rows_of(spark, s, facets)) == 4
