"""Every registered query that has SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import pytest
from compare import duck_rows, spark_rows

from quillstream.plans import catalogue, registered


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_same_rows_as_sql(spark, duck, medium, name):
    df = registered.QUERIES[name](spark, medium)
    got, want = spark_rows(df), duck_rows(duck, registered.SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in duck.execute(f"SELECT * FROM ({registered.SQL[name]}) LIMIT 0").description)
    assert len(got) == len(want)
    assert got == want
    assert got or name in {"similar_pairs", "ttl_cache"}


def test_funnel_narrows(spark, medium):
    rows = catalogue.refresh_funnel(spark, medium).orderBy("place").collect()
    counts = [r["n"] for r in rows]
    assert [r["stage"] for r in rows] == ["window", "recall", "gate", "unique", "top", "clusters"]
    assert counts == sorted(counts, reverse=True)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
