"""Sinks: results, samples, baselines and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per check result."""
    results.write.mode(mode).json(path)


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Masked sample rows (columns _test, row), one folder per check."""
    samples.write.mode(mode).partitionBy("_test").json(path)


def write_baseline(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def append_history(results: DataFrame, path: str) -> None:
    """Results of a run under run_date=..., so that listings and retention only
    open the dates they need. `run_at` orders the runs."""
    stamped = results if "run_at" in results.columns else results.withColumn("run_at", F.col("as_of"))
    stamped.withColumn("run_date", F.to_date("run_at")).write.mode("append").partitionBy(
        "run_date"
    ).parquet(path)
