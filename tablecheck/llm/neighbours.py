"""Nearest neighbours by multiprobe p-stable hashing.

1. Rows with one vector form a class, kept with its k + 1 least ids: no query needs more
   of them, so a vector that a third of all rows share is one point.
2. Each of `tables` hash tables cuts the space by `functions` random projections, in steps
   of a width. A pair at distance r differs by a normal variable of deviation r in each,
   so the chance that a cell holds a neighbour at r is a product of normal intervals.
3. A query visits the cells around its own in the order of that chance until they add up
   to `success` over all tables. r is the distance of the k-th neighbour: first that of
   nearly all queries of a sample, which is searched exactly, then, for queries whose own
   turned out larger, their own. Nothing is capped.
4. Cells are read in blocks: tasks compare a block with the queries that visit it, in
   double precision on the original vectors, and only a query's best leave. What all
   tables found is merged by distance, then id.
5. Queries that found fewer than k, or neighbours only at twice the sample's distance,
   are compared with all rows, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .base import cut, query, table

TABLES = 2
SUCCESS = 0.97
SAMPLED_QUERIES, SAMPLED_ROWS = 64, 4096
RADIUS_QUANTILE = 0.9
WIDTH = 2.8  # of a hash function's step, in distances of the k-th neighbour
CELL, BLOCK = 1000, 4096  # rows: aimed at per cell, and compared at once
QUERY_BATCH = 512
LOST = 0.2  # of the chance not asked for, given up to keep lists of cells short
SEED = 20_011


def usable(vector: Column) -> Column:
    """Whether a vector takes part: all components finite, one of them not zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """cid, vector, ids (the k + 1 least ids that have it, ascending)."""
    single = rows.select("vector", "vec_id").distinct()
    first = Window.partitionBy("vector").orderBy("vec_id")
    least = single.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1)
    grouped = least.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return cut(grouped.select(F.monotonically_increasing_id().alias("cid"), "vector", "ids"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch and their vectors, for each length of vectors in it."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        part = batch.filter(pa.array(lengths == n))
        yield part, matrix(part.column(column))


class Hashing:
    """The hash functions of all tables. `radius`: the distance to be found."""

    def __init__(self, tables: int, functions: int, radius: float, success: float) -> None:
        self.tables, self.functions, self.radius = tables, functions, radius
        self.width = WIDTH * radius
        self.need = 1 - (1 - success) ** (1 / tables)

    def places(self, number: int, vectors: np.ndarray) -> np.ndarray:
        """Where vectors lie in table `number`, in steps, one column per function."""
        rng = np.random.default_rng([SEED, number, vectors.shape[1]])
        axes = rng.normal(size=(vectors.shape[1], self.functions))
        return (vectors @ axes) / self.width + rng.uniform(size=self.functions)

    def keys(self, number: int, length: int, cells: np.ndarray) -> np.ndarray:
        """One number per cell. Two cells with one number are read together."""
        rng = np.random.default_rng([SEED, number, length, 1])
        odd = rng.integers(-(2**62), 2**62, self.functions, dtype=np.int64) * 2 + 1
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * odd).sum(1) + length

    def visited(self, place: np.ndarray, radius: float) -> np.ndarray:
        """The cells to visit from `place`, likeliest first, until their chances of
        holding a neighbour at `radius` reach what a table owes."""
        spread = radius / self.width
        reach = math.ceil(5 * spread) + 1
        cells, chance = np.zeros((1, 0), np.int64), np.ones(1)
        spare = LOST * (1 - self.need) / self.functions
        for at in place:
            steps = math.floor(at) + np.arange(-reach, reach + 1)
            below = [0.5 * math.erf((s - at) / spread / math.sqrt(2)) for s in [*steps, steps[-1] + 1]]
            ways = (chance[:, None] * np.diff(below)).ravel()
            grown = np.concatenate([np.repeat(cells, len(steps), 0), np.tile(steps, len(cells))[:, None]], 1)
            order = np.argsort(-ways, kind="stable")
            total = np.cumsum(ways[order])
            keep = order[: np.searchsorted(total, total[-1] - spare) + 1]
            cells, chance = grown[keep], ways[keep]
        return cells[: np.searchsorted(np.cumsum(chance), self.need) + 1]


def _indexed(hashing: Hashing):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors in by_length(batch, 1):
                for number in range(hashing.tables):
                    cells = np.floor(hashing.places(number, vectors))
                    keys = hashing.keys(number, vectors.shape[1], cells)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), number, np.int32)), pa.array(keys), *part.columns],
                        names=["tbl", "bucket", "cid", "vector", "ids"],
                    )

    return work


def _probes(hashing: Hashing):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors in by_length(batch, 1):
                for number in range(hashing.tables):
                    places = hashing.places(number, vectors)
                    for i, (place, radius) in enumerate(zip(places, part.column(2).to_pylist())):
                        cells = hashing.visited(place, max(radius, hashing.radius))
                        keys = np.unique(hashing.keys(number, vectors.shape[1], cells))
                        row = part.slice(i, 1).take(pa.array(np.zeros(len(keys), np.int64)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), number, np.int32)), pa.array(keys), row.column(0), row.column(1)],
                            names=["tbl", "bucket", "cid", "vector"],
                        )

    return work


def best(queries: np.ndarray, block: np.ndarray, ids: list[list[int]], n: int) -> tuple[np.ndarray, ...]:
    """(query, id, distance) of the n nearest ids of each query, ties to smaller ids, and
    all that lie as near as the last."""
    inner = (queries**2).sum(1)[:, None] + (block**2).sum(1) - 2 * queries @ block.T
    if block.shape[0] > n:
        # The short form rounds: what it puts a little beyond the n-th stays in.
        slack = 1e-9 * ((queries**2).sum(1) + (block**2).sum(1).max())
        near = inner <= (np.partition(inner, n - 1, axis=1)[:, n - 1] + slack)[:, None]
    else:
        near = np.ones(inner.shape, bool)
    q, b = np.nonzero(near)
    exact = np.sqrt(((queries[q] - block[b]) ** 2).sum(1))
    many = np.array([len(x) for x in ids])
    all_ids, start = np.concatenate([np.array(x, np.int64) for x in ids]), np.cumsum(many) - many
    times = many[b]
    row = np.repeat(np.arange(len(q)), times)
    within = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    q, exact, found = q[row], exact[row], all_ids[start[b[row]] + within]
    order = np.lexsort([found, exact, q])
    q, exact, found = q[order], exact[order], found[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < n
    return q[keep], found[keep], exact[keep]


def _compared(n: int):
    """Rows arrive by block, the block's own rows ahead of the queries that visit it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, ids = None, [], None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                part = batch.slice(lo, hi - lo)
                if tuple(keys[lo, :3]) != key:
                    key, held, block = tuple(keys[lo, :3]), [], None
                if keys[lo, 3] == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    block = np.concatenate([matrix(p.column(5)) for p in held])
                    ids, held = [x for p in held for x in p.column(6).to_pylist()], []
                if block is None:
                    continue
                for start in range(0, hi - lo, QUERY_BATCH):
                    some = part.slice(start, QUERY_BATCH)
                    q, found, score = best(matrix(some.column(5)), block, ids, n)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(4).take(pa.array(q)), pa.array(found), pa.array(score)],
                        names=["cid", "vec_id", "score"],
                    )

    return work


FOUND = "cid long, vec_id long, score double"
BLOCKS = ["tbl", "bucket", "salt"]


def compare(blocks: DataFrame, visits: DataFrame, n: int) -> DataFrame:
    """The n best of each visit. `blocks`: tbl, bucket, salt, cid, vector, ids;
    `visits`: the same without ids."""
    fields = [F.col("tbl").cast("int"), "bucket", F.col("salt").cast("int")]
    own = blocks.select(*fields, F.lit(0).alias("side"), "cid", "vector", "ids")
    asked = visits.select(*fields, F.lit(1).alias("side"), "cid", "vector", F.array().cast("array<long>").alias("ids"))
    ordered = own.unionByName(asked).repartition(*BLOCKS).sortWithinPartitions(*BLOCKS, "side")
    return ordered.mapInArrow(_compared(n), FOUND)


def merged(found: DataFrame, n: int) -> DataFrame:
    """The n best of each cid; a pair that several tables found counts once."""
    single = found.groupBy("cid", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("cid").orderBy("score", "vec_id")
    return single.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def exact(points: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """The n best of all points for each row of `asked` (cid, vector), in blocks of rows."""
    groups = points.count() // BLOCK + 1
    length = F.size("vector").cast("long")
    blocks = points.select(
        F.lit(0).alias("tbl"), length.alias("bucket"), F.pmod(F.xxhash64("cid"), F.lit(groups)).alias("salt"), "*"
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    visits = asked.select(F.lit(0).alias("tbl"), length.alias("bucket"), every.alias("salt"), "cid", "vector")
    return merged(compare(blocks, visits, n), n)


def fitted(points: DataFrame, asked: DataFrame, k: int, tables: int, success: float) -> Hashing:
    """Step widths and the number of functions, from a sample of at most SAMPLED_QUERIES
    queries, compared with all rows, and SAMPLED_ROWS rows."""
    some = cut(asked.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLED_QUERIES))
    far = exact(points, some, k + 1).groupBy("cid").agg(F.max("score").alias("score"))
    radii = [r.score for r in far.collect()]
    radius = float(np.quantile(radii, RADIUS_QUANTILE)) if radii else 0.0
    radius = radius or max(radii, default=0.0) or 1.0
    rows = points.orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(SAMPLED_ROWS).select("vector").collect()
    lengths = [len(r.vector) for r in rows]
    usual = max(set(lengths), key=lengths.count, default=1)
    kept = np.array([r.vector for r in rows if len(r.vector) == usual], np.float64).reshape(-1, usual)
    cells = np.floor(Hashing(1, 16, radius, success).places(0, kept))
    told = []
    for column in cells.T:
        share = np.unique(column, return_counts=True)[1] / max(1, len(column))
        told.append(float(-(share * np.log(share)).sum()))
    wanted = math.log(max(1.0, points.count() / CELL)) / max(0.1, float(np.mean(told)))
    return Hashing(tables, max(1, round(wanted)), radius, success)


def nearest(
    rows: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, success: float = SUCCESS
) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score (Euclidean).

    `rows`: vec_id and embedding, an array of numbers; `is_query` picks queries from them.
    Rows without id take no part, nor do vectors that are null, empty, zero or hold null or
    non-finite components. Vectors of different lengths are not compared. A row that is
    repeated counts once; an id is no neighbour of itself, and if it has several vectors, it
    asks with each and is as near as the nearest of them. Ties go to smaller ids. An empty
    table gives no row.
    """
    ready = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    ready = ready.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"), is_query.alias("asks"))
    points = classes(ready, k)
    asking = ready.where("asks").select("vec_id", "vector").distinct()
    asking = cut(asking.join(points.select("cid", "vector"), "vector").select(F.col("vec_id").alias("query_id"), "cid"))
    asked = cut(points.join(asking.select("cid").distinct(), "cid", "left_semi").select("cid", "vector"))
    hashing = fitted(points, asked, k, tables, success)

    kind = points.schema["vector"].dataType.simpleString()
    index = cut(points.mapInArrow(_indexed(hashing), f"tbl int, bucket long, cid long, vector {kind}, ids array<long>"))
    splits = (F.count(F.lit(1)) / BLOCK + 1).cast("int")
    buckets = cut(index.groupBy("tbl", "bucket").agg(splits.alias("splits")))
    salt = F.pmod(F.xxhash64("cid"), F.col("splits"))
    blocks = index.join(buckets, ["tbl", "bucket"]).withColumn("salt", salt)

    def search(some: DataFrame) -> DataFrame:
        visits = some.mapInArrow(_probes(hashing), f"tbl int, bucket long, cid long, vector {kind}")
        every = F.explode(F.sequence(F.lit(0), F.col("splits") - 1))
        visits = visits.join(buckets, ["tbl", "bucket"]).withColumn("salt", every)
        return cut(merged(compare(blocks, visits, k + 1), k + 1).drop("rn"))

    found = search(asked.withColumn("radius", F.lit(hashing.radius)))
    reached = found.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("radius"))
    state = cut(asked.join(reached, "cid", "left").fillna(0, ["n"]))
    short = (F.col("n") <= k) | (F.col("radius") > 2 * hashing.radius)
    wider = state.where(~short & (F.col("radius") > hashing.radius)).select("cid", "vector", "radius")
    found = found.unionByName(search(wider))
    alone = state.where(short).select("cid", "vector")
    found = found.unionByName(exact(points, alone, k + 1).drop("rn"))
    hits = asking.join(merged(found, k + 1), "cid").where("vec_id <> query_id")
    closest = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = closest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query("op12_nearest_neighbours")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
