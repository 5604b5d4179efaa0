"""Stories meet only their own reader's phrases, in one pass over the texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_tagging import plain

from quillstream.functions import phrases
from quillstream.operators import tagging
from quillstream.plans.registered import QUERIES


def test_tags_of_many_chunks_and_parts(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["us", "Use", "u.s.", "new york", "york", "é", "@who", "WHO", "_", " ", "  ", ".", "-", ", ", "müller"]
    made = lambda most: "".join(rng.choice(parts) for _ in range(rng.randrange(most)))
    settings = sorted({(r, made(4).strip()) for r in range(3) for _ in range(60)} | {(0, "use york")})
    stories = [(i % 4, i, made(20)) for i in range(300)] + [(0, 0, "use york"), (1, None, "us"), (None, 7, "us")]
    rows = spark.createDataFrame(stories, "reader int, story int, evidence string").withColumns({c: F.lit(None).cast("array<string>") for c in ("item_topics", "item_geographies")})
    own = spark.createDataFrame([(r, "keywords", x) for r, x in [*settings, (None, "us")]], "reader int, axis string, label string")
    want: dict[tuple, set] = {(r, s): set() for r, s, _ in stories}
    for r, s, text in stories:
        if s is not None:
            want[r, s] |= {x for q, x in settings if q == r and x and plain(text, [x.lower()])}
    for block, chunk in ((2_000_000, 8 << 20), (60, 100)):
        monkeypatch.setattr(phrases, "BLOCK_CHARS", block)
        monkeypatch.setattr(tagging, "CHUNK_BYTES", chunk)
        out = tagging.story_tags(rows, own)
        got = [(r["reader"], r["story"], r["keywords"]) for r in out.collect()]
        assert len(got) == len(want) and {(r, s): set(k) for r, s, k in got} == want
        assert all(k == sorted(k, key=lambda x: (x.lower(), x)) for _, _, k in got)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "EvalPython" not in plan and plan.count("FlatMapCoGroupsInArrow") == 1


def test_semantic_tags_work_out_tags_once(spark, small):
    plan = QUERIES["semantic_tags"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "FlatMapCoGroups" not in plan
