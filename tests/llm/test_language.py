"""Language ID: held-out accuracy, what is learnt from, odd rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillstream.llm import langid
from quillstream.llm import queries as Q
from quillstream.llm.langid import claimed, identify, ngram_columns, training_sample

ROW = "doc_id long, text string, lang string, score string, lang_pred string, row int"


def test_held_out_accuracy(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = Q.op4_language_id(spark, medium).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    unseen = got[got.held_out & got.lang.notna()]
    assert len(unseen) > 200
    assert (unseen.lang == unseen.lang_pred).mean() >= 0.98


def _texts(n, alphabet, seed, words=30):
    rng = np.random.default_rng(seed)
    return [" ".join("".join(rng.choice(list(alphabet), rng.integers(2, 8))) for _ in range(words)) for _ in range(n)]


def test_a_language_of_long_texts_only_is_learnt(spark):
    rows = [(i, t, "aa") for i, t in enumerate(_texts(40, "abcde", 1))] + [(100 + i, t, "bb") for i, t in enumerate(_texts(12, "vwxyz", 2, 6000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang"] for r in training_sample(docs).collect()} == {"aa", "bb"}
    assert {r["lang_pred"] for r in identify(docs).filter("doc_id >= 100").collect()} == {"bb"}


def test_sample_keeps_its_budget_and_leaves_no_language_out(spark):
    rows = [(i, t, "aa") for i, t in enumerate(_texts(300, "abcde", 1))] + [(1000, "vwxyz " * 10_000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = training_sample(docs, budget=2000).toPandas().groupby("lang").text.agg(lambda x: x.str.len().sum())
    assert 2000 <= got["aa"] <= 2000 + 300 and got["bb"] == 60_000
    assert training_sample(docs, per_language=50).groupBy("lang").count().filter("lang = 'aa'").first()["count"] == 50


def test_blocks_do_not_change_the_columns(monkeypatch):
    text = "".join(np.random.default_rng(1).choice(list("abcdefghij "), 1000))
    whole = ngram_columns(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (ngram_columns(text) == whole).all()


def test_odd_rows(spark):
    """Nulls, no letters, long texts, ties, repeated rows and ids, a null id, no training row, empty tables, clashing columns."""
    rows = [(i, t, "aa") for i, t in enumerate(_texts(30, "abcde", 1))] + [(50 + i, t, "bb") for i, t in enumerate(_texts(30, "vwxyz", 2))]
    odd = [(200, None, "aa"), (201, "", "aa"), (202, "12 !? 34", "bb"), (203, "abcde " * 60_000, None), (None, rows[0][1], "aa"), rows[0], rows[0], (0, "vwxyz vwx", "bb")]
    docs = spark.createDataFrame([(*r, "mine", "own", 3) for r in rows + odd], ROW)
    got = {}
    for r in identify(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["held_out"]))
    assert [got[i][0][0] for i in (200, 201, 202)] == ["und"] * 3 and got[203][0][0] == "aa"
    assert got[None] == [("aa", False)] and sorted(x for x, _ in got[0]) == ["aa", "aa", "aa", "bb"]
    kept = claimed(docs, 0.53)
    assert kept.columns == docs.columns
    assert {(r["score"], r["lang_pred"], r["row"]) for r in kept.collect()} == {("mine", "own", 3)}
    assert kept.filter("doc_id in (200, 201, 202)").count() == 0
    none = spark.createDataFrame([], docs.schema)
    assert identify(none).count() == claimed(none, 0.5).count() == 0
    unlearnt = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in identify(unlearnt).collect()} == {("und", 0.0)}
