"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import leaks
from .filter_audit import SQL as AUDIT_SQL
from .filter_audit import audit
from .kd_shards import kd_shards
from .langid import identify
from .ngram_join import ngram_components
from .packing import pack
from .periodic_runs import periodic_runs, run_digests, with_planted_runs
from .quality import quality
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .token_output import write_shards
from .warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), limit=4096)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), most=2048, end_id=1)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), length=200)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(_table(spark, sf_dir, "documents"), length=2048, per_shard=4096)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"), least=1000)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents"))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_table(spark, sf_dir, "documents"), shards=24)


QUERIES = (op1_token_counts, op2_ngram_join, op3_quality_rules, op4_language_id, op5_packing, op6_substring_dedup, op7_decontamination, op8_suffix_dedup, op9_token_output, op10_warc, op11_periodic_runs, op12_filter_audit, op13_sharding)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_audit": AUDIT_SQL}
