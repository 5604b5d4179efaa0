"""Capitals letter by letter, and the two queries whose second text is in capitals, against their SQL on texts with a sharp s."""

from __future__ import annotations

import duckdb
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from quillstream.functions.text import upper_letters
from quillstream.plans.registered import QUERIES, SQL

TEXTS = ["Te keitä engeß stäzu üzuver der.\nGroß, ſehr groß\nﬁn", "straße ŉ ǰ ᾳ ᾀ και \U0001f600", "plain\nwords here", "", None, "ß"]


def test_upper_letters(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(upper_letters(F.col("t"))).collect()
    assert [r[0] for r in got] == [r[0] for r in duckdb.execute("SELECT upper(unnest($1::VARCHAR[]))", [TEXTS]).fetchall()]


@pytest.mark.parametrize("name", ["line_repeats", "translated_evidence"])
def test_sharp_s(spark, tmp_path, name):
    rows = [(i, TEXTS[i % 6], ("de", "es", "fr", "en")[i % 4 if i < 12 else 1], "src0", 0) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert spark_rows(QUERIES[name](spark, str(tmp_path))) == duck_rows(con, SQL[name])
