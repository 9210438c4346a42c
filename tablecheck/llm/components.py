"""Connected components of an edge table by repeated stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node reachable.

    Each round every node links its neighbours to the least node it knows of; when
    nothing changes, all edges lead to roots. Rounds grow with the logarithm of a
    component's size; each ends in a written table, and a node's neighbours are
    only ever reduced to their minimum, never gathered.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a")
        links = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        now = cut(links.where("a > b").distinct())
        last, state = state, _state(now)
        if last == state:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    own = now.select(F.col("b").alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    return cut(roots.unionByName(own.withColumn("root", F.col("node"))))


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free hash: equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1000003)).first())
