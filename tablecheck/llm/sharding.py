"""Shards of near equal bytes: a k-d tree over document metadata.

A node that stands for several shards is cut at a weighted median of its widest
dimension: at half of its bytes if they are even in number. Medians are found by radix descent: sums of bytes per (node, bin) over
16 bits of the coordinate at a time, then over the next 16 bits inside the bin that
holds the median, until a bin's edge is near enough to half. Only sums are
shuffled, and one row per node reaches the driver.

The low bits of every coordinate are a hash of the text, then of doc_id: equal texts
share a shard unless one group of them is too heavy for balance, and even then a cut
exists inside the group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .base import cut, query, rows_frame, table

SHARDS = 16
TOLERANCE = 0.001
SHIFTS = (46, 30, 14, 0)  # of a coordinate of 62 bits: dimension 16, text 32, doc_id 14
SLOT_ROWS = 10_000


def numeric(value: Column) -> Column:
    return value.cast("double")


def category(value: Column) -> Column:
    """A fixed place in [0, 1) for each value."""
    return F.pmod(F.xxhash64(value), F.lit(1 << 20)) / F.lit(float(1 << 20))


def text_dimensions() -> dict[str, Column]:
    """Bytes (logarithm), language, and bytes per character: equal for equal texts
    of one language."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text) + 1
    return {
        "size": numeric(F.log2(size)),
        "lang": category(F.col("lang")),
        "script": numeric(size / (F.length(text) + 1)),
    }


def _metadata(docs: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """doc_id, size, text_crc32 and a coordinate c0, c1... of 62 bits for each
    dimension: its place between the least and the greatest value in 16 bits, then
    the hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("__t"),
            *[v.alias(f"d{i}") for i, v in enumerate(dimensions.values())],
        )
    )
    names = [f"d{i}" for i in range(len(dimensions))]
    ends = raw.agg(*[F.min(n).alias(f"{n}_lo") for n in names], *[F.max(n).alias(f"{n}_hi") for n in names]).first()
    text_bits = F.shiftrightunsigned(F.col("__t"), 32)
    low = F.shiftleft(text_bits, 14).bitwiseOR(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 14)))
    made = []
    for i, n in enumerate(names):
        lo, hi = ends[f"{n}_lo"], ends[f"{n}_hi"]
        wide = (hi - lo) if lo is not None and hi > lo else None
        place = F.lit(0) if wide is None else F.floor((F.col(n) - lo) / wide * 65535)
        made.append(F.shiftleft(F.coalesce(place, F.lit(0)).cast("long"), SHIFTS[0]).bitwiseOR(low).alias(f"c{i}"))
    return raw.select("doc_id", "size", "text_crc32", *made)


def _medians(rows: DataFrame, nodes: dict[int, tuple[int, int, float]], dims: int) -> dict[int, int]:
    """A cut for each node {id: (dimension, bytes, wanted)}: coordinates below it hold
    about `wanted` bytes, and on neither side none, if rows can be told apart."""
    cuts: dict[int, int] = {}
    open_nodes = {n: (d, total, 0, 0) for n, (d, total, _) in nodes.items()}  # dimension, total, prefix, bytes before
    for shift in SHIFTS:
        if not open_nodes:
            break
        width = 62 if shift == SHIFTS[0] else SHIFTS[SHIFTS.index(shift) - 1]
        asked = rows_frame(
            rows.sparkSession,
            "node long, dim int, prefix long, need double",
            [(n, d, p, nodes[n][2] - before) for n, (d, _, p, before) in open_nodes.items()],
        )
        at = F.element_at(F.array(*[F.col(f"c{i}") for i in range(dims)]), F.col("dim") + 1)
        inside = rows.join(F.broadcast(asked), "node").withColumn("at", at)
        if width < 62:
            inside = inside.where(F.shiftright("at", width) == F.col("prefix"))
        bins = inside.groupBy("node", "need", F.shiftright("at", shift).alias("bin")).agg(F.sum("size").alias("bytes"))
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = bins.withColumn("upto", F.sum("bytes").over(upto)).where("upto >= need").groupBy("node")
        for r in first.agg(F.min_by(F.struct("bin", "bytes", "upto"), "bin").alias("b")).collect():
            n, (bin_, size, upto_) = r["node"], r["b"]
            d, total, _, before = open_nodes.pop(n)
            upper, lower, wanted = before + upto_, before + upto_ - size, nodes[n][2]
            if min(upper - wanted, wanted - lower) <= TOLERANCE * total or shift == 0:
                end = upper - wanted < wanted - lower
                if lower == 0 or upper == total:
                    end = lower == 0
                cuts[n] = (bin_ + 1 if end else bin_) << shift
            else:
                open_nodes[n] = (d, total, bin_, before + upto_ - size)
    return cuts


def kd_shards(docs: DataFrame, target_bytes: float | None = None, shards: int = SHARDS, dimensions=None) -> DataFrame:
    """doc_id, size, text_crc32, shard for every row, shard from 0 to `shards` - 1.

    A node stands for a number of shards; it is cut where the bytes below are in
    proportion to half of them, until it stands for one. With `target_bytes` there are
    as many shards as bytes ask for. Rows that agree in doc_id and text stay together: a
    node of nothing else is one shard, and the numbers it leaves over are not used, as
    when there are fewer rows than shards.

    Null text: no bytes, size 1. A null metadata value lies at the least place of
    its dimension. An empty table gives no rows. Extra columns are ignored.
    """
    dims = text_dimensions() if dimensions is None else dimensions
    rows = _metadata(docs, dims).withColumn("node", F.lit(1).cast("long"))
    # Of each node: the first of its shards, how many, and the bytes of its parent.
    spans: dict[int, tuple[int, int, int | None]] = {}
    leaves: set[int] = set()
    depth = 0
    while True:
        ends = [F.min(F.shiftright(f"c{i}", SHIFTS[0])).alias(f"lo{i}") for i in range(len(dims))]
        ends += [F.max(F.shiftright(f"c{i}", SHIFTS[0])).alias(f"hi{i}") for i in range(len(dims))]
        found = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()
        if depth == 0 and found:
            count = shards if target_bytes is None else math.ceil(found[0]["bytes"] / target_bytes)
            spans[1] = (0, max(1, count), None)
        nodes = {}
        for r in found:
            n, (_, many, above) = r["node"], spans[r["node"]]
            # A cut that left all on one side met rows that nothing tells apart.
            if n in leaves or many == 1 or r["bytes"] == above:
                leaves.add(n)
            else:
                widest = max(range(len(dims)), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
                nodes[n] = (widest, r["bytes"], r["bytes"] * (many // 2) / many)
        if not nodes:
            break
        cuts = _medians(rows, nodes, len(dims))
        for n, (_, total, _) in nodes.items():
            first, many, _ = spans[n]
            spans[2 * n] = (first, many // 2, total)
            spans[2 * n + 1] = (first + many // 2, many - many // 2, total)
        asked = rows_frame(
            rows.sparkSession, "node long, dim int, cut long", [(n, nodes[n][0], c) for n, c in cuts.items()]
        )
        at = F.element_at(F.array(*[F.col(f"c{i}") for i in range(len(dims))]), F.col("dim") + 1)
        child = 2 * F.col("node") + (at >= F.col("cut")).cast("long")
        split = rows.join(F.broadcast(asked), "node", "left").withColumn(
            "node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(child)
        )
        rows = split.drop("dim", "cut")
        depth += 1
        if depth % 4 == 0:
            rows = cut(rows)
    numbers = rows_frame(rows.sparkSession, "node long, shard int", [(n, spans[n][0]) for n in sorted(leaves)])
    return rows.join(F.broadcast(numbers), "node").select("doc_id", "size", "text_crc32", "shard")


def with_slots(placed: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """A gapless slot from 0 within each shard: rows are numbered within small
    hash parts of a shard, behind the counts of the parts before."""
    placed = cut(placed)
    parts = max(1, math.ceil(placed.count() / SHARDS / slot_rows))
    rows = placed.withColumn("__part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    counts = cut(counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    order = Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32")
    numbered = rows.join(counts, ["shard", "__part"]).withColumn("slot", F.col("__ahead") + F.row_number().over(order) - 1)
    return numbered.drop("__part", "__ahead")


@query("op7_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    placed = with_slots(kd_shards(table(spark, folder, "documents")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
