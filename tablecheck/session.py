"""Session settings for large runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# What a run over tens of terabytes needs beyond Spark's defaults.
# Partition counts are left to adaptive execution: start high, coalesce to the
# advisory size, split what is skewed.
LARGE_RUN = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings; later `.config(...)` calls override them."""
    for key, value in LARGE_RUN.items():
        builder = builder.config(key, value)
    return builder
