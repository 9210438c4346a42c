"""Past runs: listing, paging, statistics, trend, retention."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.times import moment


def list_runs(
    runs: DataFrame,
    status: str | None = None,
    suite: str | None = None,
    date_from: Any = None,
    date_to: Any = None,
    limit: int = 50,
    offset: int = 0,
    with_total: bool = False,
) -> DataFrame:
    """A page of run summaries, newest first; both ends of the date range count.
    `with_total` adds the number of matching runs."""
    if status is not None:
        runs = runs.filter(F.col("status") == status)
    if suite is not None:
        runs = runs.filter(F.contains(F.lower("suite_name"), F.lit(suite.lower())))
    if date_from is not None:
        runs = runs.filter(F.col("started_at") >= moment(date_from))
    if date_to is not None:
        runs = runs.filter(F.col("started_at") <= moment(date_to))
    page = runs.orderBy(F.desc("started_at"), "run_id").offset(offset).limit(limit)
    if with_total:
        page = page.withColumn("total", runs.agg(F.count(F.lit(1)).alias("n")).scalar())
    return page


def run_results(history: DataFrame, run_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return history.filter(F.col("run_id") == run_id).orderBy("test").offset(offset).limit(limit)


def run_stats(runs: DataFrame, last: int = 100) -> DataFrame:
    """Over the newest runs: how many, share completed, mean duration, active."""
    recent = runs.orderBy(F.desc("started_at"), "run_id").limit(last)
    done = F.col("status") == "completed"
    total = F.count(F.lit(1))
    ms = F.col("execution_time_ms")
    return recent.agg(
        total.alias("total_runs"),
        F.when(total > 0, F.count_if(done) * 100.0 / total).cast("double").alias("success_rate"),
        F.when(F.count(ms) > 0, F.sum(ms).cast("double") / F.count(ms)).alias("avg_duration_ms"),
        F.count_if(F.col("status") == "running").alias("active_runs"),
    )


def execution_metrics(history: DataFrame) -> DataFrame:
    """Executions by type and status with the spread of their duration."""
    ms = F.col("duration_ms")
    return history.groupBy("type", "status").agg(
        F.count(F.lit(1)).alias("executions"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        (F.sum(ms).cast("double") / F.count(ms)).alias("avg_ms"),
        F.percentile_approx(ms, 0.5, 10000).alias("p50_ms"),
        F.percentile_approx(ms, 0.95, 10000).alias("p95_ms"),
    )


def trend(history: DataFrame) -> DataFrame:
    """Each observation against the one before it of the same check. A check has
    one row per run, so its group is as long as its history, not as its data."""
    w = W.partitionBy("test").orderBy("run_at", "run_id")
    before = F.lag("observed").over(w)
    return history.select(
        "test",
        "run_id",
        "run_at",
        "observed",
        before.alias("previous"),
        (F.col("observed") - before).alias("change"),
        F.when(before != 0, (F.col("observed") - before) / F.abs(before) * 100).alias("change_pct"),
    )


def retain(history: DataFrame, run_days: int = 90, as_of: Any = None, column: str = "run_at") -> DataFrame:
    """Rows within the retention period (on `run_date` partitions the filter
    prunes folders)."""
    from ..functions.times import interval

    edge = moment(as_of) - interval(days=run_days)
    kept = history.filter(F.col(column) >= edge)
    if "run_date" in history.columns:
        kept = kept.filter(F.col("run_date") >= F.to_date(edge))
    return kept


def purge_history(spark: Any, path: str, run_days: int = 90, as_of: Any = None) -> int:
    """Delete whole run_date partitions older than the retention period."""
    from ..functions.times import interval

    history = spark.read.parquet(path)
    edge = F.to_date(moment(as_of) - interval(days=run_days))
    old = [
        str(r.run_date)
        for r in history.select("run_date").distinct().filter(F.col("run_date") < edge).collect()
    ]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for day in old:
        p = fs_path(f"{path}/run_date={day}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)
