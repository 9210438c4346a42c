from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"


class Tables:
    """Reads tables on demand: `t.orders`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def verdict(
    results: DataFrame, *plain: str, named: dict[str, tuple[str, str]] | None = None, **metrics: str
) -> DataFrame:
    """Status and violations, further result columns, and single metrics:
    `total_rows="bigint"` reads metric total_rows, `named` gives a metric another
    column name."""
    wanted = {k: (k, t) for k, t in metrics.items()} | (named or {})
    return results.select(
        "status",
        "violations",
        *plain,
        *[F.col("metrics")[key].cast(t).alias(name) for name, (key, t) in wanted.items()],
    )


def status_sql(bad: str) -> str:
    return f"CASE WHEN {bad} THEN 'fail' ELSE 'pass' END AS status"
