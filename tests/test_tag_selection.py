"""Stories are picked by their tags, and each text is split into its words once."""

from __future__ import annotations

import re

from quillstream.plans.registered import QUERIES

TEXTS = ["que la", "que x x la", "x que la", "x x la que x", "QUE x Die", "que x la", "x x x x de la Los", "", None, "que", "--que  b. ELLE", "x x thes x les", "para x thes"]


def test_odd_texts(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: re.split("[^a-z0-9_]+", (t or "").lower()) for i, t in rows}
    want = [i for i, w in words.items() if {"que", "de", "der", "para", "les"} & {*w[::4]} and {"la", "de", "die", "los", "elle", "thes", "que"} & {*w[2::4]}]
    assert want and sorted(r[0] for r in QUERIES["tag_selection"](spark, str(tmp_path)).collect()) == want


def test_a_text_is_split_once(spark, small):
    """Within the filter each word's place split the whole text anew."""
    plan = QUERIES["tag_selection"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
