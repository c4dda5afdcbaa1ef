"""Comparison of many evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AVERAGES = ("macro avg", "weighted avg")
METRICS = ("precision", "recall", "f1")


def report_row(report: DataFrame, key: str) -> DataFrame:
    """The rows of a report with a given key."""
    return report.where(F.col("row_key") == key)


def average_metrics(reports: DataFrame, run: str = "run_id") -> DataFrame:
    """Accuracy and macro and weighted averages of every run, averaged over its labels."""
    accuracy = F.avg(F.when(F.col("row_key") == "accuracy", F.col("precision"))).alias("accuracy")
    others = [
        F.avg(F.when(F.col("row_key") == avg, F.col(m))).alias(f"{m}_{avg.split()[0]}")
        for avg in AVERAGES
        for m in METRICS
    ]
    return reports.groupBy(run).agg(accuracy, *others)


def run_comparison(headers: DataFrame, samples: DataFrame, reports: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run: token totals, prompt, budget, samples, latency and average metrics.

    Runs without a report or without samples are left out; ``missing_runs`` lists them.
    """
    response = F.col("response")
    usage = samples.groupBy(run).agg(
        *[F.sum(response.getField(f).cast("long")).alias(f)
          for f in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.count("*").alias("samples"),
    )
    joined = headers.join(usage, run).join(average_metrics(reports, run), run)
    metrics = [f"{m}_{avg.split()[0]}" for avg in AVERAGES for m in METRICS]
    return joined.select(
        run, "prompt_tokens", "completion_tokens", "total_tokens",
        F.col("config.prompt").alias("prompt"), F.col("config.max_tokens").alias("max_tokens"),
        "samples", "accuracy", (F.col("total_time_elapsed") / F.col("samples")).alias("latency"), *metrics)


def missing_runs(headers: DataFrame, reports: DataFrame, run: str = "run_id", samples: DataFrame | None = None) -> DataFrame:
    """Runs that are listed but have no report, or no samples where these are given."""
    lost = headers.join(reports, run, "left_anti").select(run)
    if samples is None:
        return lost
    return lost.union(headers.join(samples, run, "left_anti").select(run)).distinct()
