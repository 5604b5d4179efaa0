"""The pipeline's language stage keeps the learned languages and drops what none of them claims."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "cjk": "".join(chr(0x4E00 + i) for i in range(3000)),
}


def test_texts_of_no_learned_language_go(spark, medium):
    rng = random.Random(8)
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    strange = [(10**9 + i, " ".join("".join(rng.choices(a, k=rng.randrange(1, 9))) for _ in range(rng.choice((30, 100, 300))))) for i, a in enumerate(a for a in ALPHABETS.values() for _ in range(20))]
    rows = spark.createDataFrame(strange, "doc_id long, text string").select("doc_id", "text", *(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields if f.name not in ("doc_id", "text")))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(rows), medium).select("doc_id").collect()}
    assert not kept & {i for i, _ in strange}
    every = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(kept) >= 0.98 * len(every)
