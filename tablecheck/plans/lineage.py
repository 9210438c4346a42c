"""Lineage edges and impact."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir. Only a
    local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablecheck-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def lineage_edges(datasets: DataFrame) -> DataFrame:
    """(upstream, downstream) from catalog datasets."""
    return datasets.select(
        F.explode("lineage").alias("upstream"), F.col("dataset").alias("downstream")
    ).distinct()


def downstream(edges: DataFrame, changed: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Everything reachable from `changed` (column dataset), with the smallest
    number of steps; the changed datasets themselves have depth 0.

    Breadth first, one join per level. Each level keeps only datasets not seen
    before, so cycles end and diamonds do not multiply. Levels are checkpointed:
    the plan stays short and survives lost executors. `edges` is checkpointed
    once so that it is not recomputed per level.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select("upstream", "downstream").distinct().checkpoint()
    frontier = (
        changed.select("dataset")
        .filter(F.col("dataset").isNotNull())
        .distinct()
        .withColumn("depth", F.lit(0))
        .checkpoint()
    )
    seen = frontier
    depth = 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        reached = (
            links.join(frontier, links.upstream == frontier.dataset, "left_semi")
            .select(F.col("downstream").alias("dataset"))
            .distinct()
        )
        frontier = (
            reached.join(seen.select("dataset"), "dataset", "left_anti")
            .withColumn("depth", F.lit(depth))
            .checkpoint()
        )
        seen = seen.unionByName(frontier)
    return seen


def select_impacted(suite: DataFrame, diff: DataFrame, edges: DataFrame) -> DataFrame:
    """Suite rows (column dataset) on changed datasets or anything downstream."""
    hit = downstream(edges, diff.select("dataset").distinct())
    return suite.join(hit.select("dataset"), "dataset", "left_semi")
