"""A task's share of the claims does not grow with their table."""

from __future__ import annotations

from quillstream.operators import stories
from quillstream.plans.registered import QUERIES


def test_claims_are_dealt_into_tasks_of_so_many_rows(spark, small, monkeypatch):
    want = sorted(map(tuple, QUERIES["grounding"](spark, small).collect()))
    monkeypatch.setattr(stories, "TASK_ROWS", 500)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    out = QUERIES["grounding"](spark, small)
    assert out.rdd.getNumPartitions() == rows // 500 + 1 > 8 and sorted(map(tuple, out.collect())) == want
