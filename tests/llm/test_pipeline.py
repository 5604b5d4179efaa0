"""Every stage of the pipeline against a plain version of it, on its predecessor's whole output, and on odd rows."""

from __future__ import annotations

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_contracts import _packs
from test_decontaminate import _brute as leaking
from test_substring import brute as cut

from quillstream.llm.common import materialise
from quillstream.llm.langid import identify
from quillstream.llm.substring_dedup import LEAST_WORDS

STAGES = dict(corpus_pipeline.STAGES)


def _rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, small), name)
        before, after = _rows(docs), _rows(out) if name != "packing" else {}
        if name == "language_id":
            own = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs).collect()}
            assert after == {i: t for i, t in before.items() if own[i][0] != "und" and own[i][1] >= corpus_pipeline.LEAST_SCORE}
            assert len(after) >= 0.9 * len(before)
        elif name == "ngram_jaccard_join":
            groups = brute.components(sorted(before.items()), 5, 80)
            assert after == {i: t for i, t in before.items() if groups[i][1] == i}
        elif name == "substring_dedup":
            want = cut(sorted(before.items()), LEAST_WORDS)
            assert after == {i: t for i, t in want.items() if t or not before[i]}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            found = {hit[0] for hit in leaking(sorted(before.items()), items)}
            assert found and after == {i: t for i, t in before.items() if i not in found}
        else:
            _packs(out, list(before.items()))
        if name != "packing":
            assert out.columns == docs.columns
            docs = out


@pytest.fixture(scope="module")
def odd(spark, small):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, a null id, and columns that clash with the stages' own."""
    rng = random.Random(4)
    words = spark.read.parquet(f"{small}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").first()["text"].split()
    base, other = (" ".join(rng.choice(words) for _ in range(120)) for _ in range(2))
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)), "en") for i in range(40)]
    rows += [(50, base, "en"), (51, base + " more", "en"), (51, other, None), (51, other, None), (52, None, None), (53, "", "en"), (54, " ".join(rng.choice(words) for _ in range(50_000)), None), (None, base, "en"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text"))
    for name in ("score", "lang_pred", "u", "row", "removal", "marks", "spans", "n_bytes", "component", "n", "length", "start", "sequence_id", "_part"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_odd_rows_and_empty_tables(spark, small, odd, name):
    out = STAGES[name](spark, odd, small)
    assert out.columns == odd.columns
    rows = out.collect()
    assert all(r["score"] == "own score" and r["row"] == "own row" and r["u"] == "own u" for r in rows)
    got = sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)
    if name == "language_id":
        assert {52, 53} & {i for i, _ in got} == set() and len(got) == odd.count() - 3
    if name == "ngram_jaccard_join":
        own = [i for i, _ in got]
        assert own.count(50) == 1 and own.count(51) == 1 and own.count(None) == 2  # 51's other text is its own document
    if name == "substring_dedup":
        assert own_text(got, 50) and not any(i == 51 and t and t.startswith(own_text(got, 50)) for i, t in got)
    assert STAGES[name](spark, odd.limit(0), small).count() == 0


def own_text(rows, i):
    return next(t for j, t in rows if j == i)


def test_packing_of_odd_rows(spark, small, odd):
    rows = STAGES["packing"](spark, odd, small)
    want = {}
    for r in odd.collect():
        want.setdefault(r["doc_id"], 0)
        want[r["doc_id"]] += len(brute.packed_ids([(0, r["text"])])[0]) // 4
    assert {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
    assert STAGES["packing"](spark, odd.limit(0), small).count() == 0


def test_run_writes_each_stage(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and "sequence_id" in out.columns
