"""The corpus pipeline: five stages over ``documents``, each reread from Parquet by the next.

Language ID, one document of each near-duplicate group, substring dedup,
benchmark decontamination, packing. Every stage but the last returns the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import discard, materialise
from quillstream.llm.decontaminate import without_leaks
from quillstream.llm.langid import claimed
from quillstream.llm.ngram_join import one_of_each
from quillstream.llm.packing import pack
from quillstream.llm.substring_dedup import cut_rows

#: Below this score no language claims a text: texts unlike every learned language score near 0.5, the zero
#: margin. Of 1,501 rows kept from the fit 7 lie below, and all random texts of 20 words or more in four scripts.
LEAST_SCORE = 0.53

#: Bytes of texts that a task hands to its Python worker at once: an executor's workers and its JVM hold two of these
#: batches a task, beside the memory that shuffles take.
BATCH = "8m"


def _bounded(spark: SparkSession) -> None:
    """The pipeline is a job of its own, and settles this for its session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learned language claims."""
    _bounded(spark)
    return claimed(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles at a similarity of 0.8 or more."""
    _bounded(spark)
    return one_of_each(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated units from the texts, and documents of which nothing is left."""
    _bounded(spark)
    left = cut_rows(docs).filter("removal.n_removed = 0 or removal.n_removed < removal.n_bytes")
    new = {"text": F.col("removal.text"), "n_chars": F.length("removal.text").cast(docs.schema["n_chars"].dataType)}
    return left.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    _bounded(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of power-of-two lengths up to 2,048."""
    _bounded(spark)
    return pack(docs, most=2048, end_id=1)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("packing", packing),
]

#: SQL cannot express the stages; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written and reread as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)
