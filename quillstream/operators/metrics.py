"""Rates, percentiles, funnels, set metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import MIN_STORIES, MIN_SUCCESS


def nearest_rank(column: str, p: float) -> Column:
    """The nearest-rank percentile of a column."""
    return F.expr(f"percentile_disc({float(p)}) within group (order by `{column}`)")


def set_metrics(predicted: Column, expected: Column) -> dict[str, Column]:
    """Precision, recall, F1 and exact match of two arrays as sets without regard to case; both empty give 1."""
    p = F.array_distinct(F.transform(predicted, lambda x: F.lower(F.trim(x))))
    e = F.array_distinct(F.transform(expected, lambda x: F.lower(F.trim(x))))
    hit, n, m = F.size(F.array_intersect(p, e)), F.size(p), F.size(e)
    none = (n == 0) & (m == 0)
    precision = F.when(none, 1.0).when(n == 0, 0.0).otherwise(hit / n)
    recall = F.when(none, 1.0).when(m == 0, 0.0).otherwise(hit / m)
    return {"precision": precision, "recall": recall, "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), "exact": (hit == n) & (hit == m)}


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of two flags; empty denominators give 1."""
    flags = [F.count_if(F.expr(f"{predicted} and {actual}")).alias("tp"), F.count_if(F.expr(f"{predicted} and not {actual}")).alias("fp"), F.count_if(F.expr(f"not {predicted} and {actual}")).alias("fn")]
    out = rows.agg(*flags)
    out = out.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0))).withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0)))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def rolling_rate(rows: DataFrame, by: list[str], order: list[str], flag: Column, n: int = 10) -> Column:
    """The flag's rate over the last n rows of the key."""
    return F.avg(flag.cast("double")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0))


def greatest_drop(stages: DataFrame, stage: str, place: str, n: str) -> DataFrame:
    """The stage that loses most against the one before; stages without a count are skipped, the first of equals wins."""
    order = Window.orderBy(place)  # a handful of stages
    lost = stages.filter(F.col(n).isNotNull()).withColumn("dropped", F.lag(n).over(order) - F.col(n))
    return lost.filter("dropped is not null").orderBy(F.col("dropped").desc(), place).limit(1).select(stage, "dropped")


def fingerprint(ids: Column, lo: Column, hi: Column, feeds: Column, n: Column) -> Column:
    """16 hex digits over sorted distinct ids, their count, the hour bounds and feeds."""
    body = F.to_json(F.struct(F.array_sort(ids).alias("ids"), n.alias("count"), lo.alias("min"), hi.alias("max"), F.array_sort(feeds).alias("feedIds")), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(body, 256), 1, 16)


def run_summary(runs: DataFrame) -> DataFrame:
    """Of all runs (stories, fallback, pipeline_ms): number, success rate, median of stories, 95th percentile of the time."""
    out = runs.agg(
        F.count("*").alias("runs"), F.coalesce(F.avg((F.col("fallback") == F.lit(False)).cast("double")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.median("stories"), F.lit(0.0)).alias("median_stories"), nearest_rank("pipeline_ms", 0.95).alias("p95_pipeline_ms"),
    )
    return out.withColumn("passed", (F.col("success_rate") >= MIN_SUCCESS) & (F.col("median_stories") >= MIN_STORIES))


def counted_by(rows: DataFrame, column: str) -> DataFrame:
    """Rows by a column's value, without nulls."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def recommended_threshold(rows: DataFrame, threshold: str, recall: str, slack: float = 0.05) -> DataFrame:
    """The highest threshold whose recall is within ``slack`` of the best."""
    best = rows.agg(F.max(recall).alias("_best"))
    return rows.join(F.broadcast(best), F.col(recall) >= F.col("_best") - slack).agg(F.max(threshold).alias("recommended"))


def mean_rank(rows: DataFrame, by: list[str], order: list[Column], flag: str) -> DataFrame:
    """Mean place of the flagged rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(flag).groupBy(*by).agg(F.avg("_r").alias("mean_rank"), F.count("*").alias("n"))
