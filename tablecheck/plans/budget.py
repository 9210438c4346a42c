"""What a suite will cost and which checks fit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, WindowSpec, functions as F

from ..functions.hashing import sample_bucket
from ..sources.local import local_frame
from ..spec import SEVERITIES, Suite


def severity_rank(c: Column) -> Column:
    out = F.lit(len(SEVERITIES) + 1)
    for i, s in reversed(list(enumerate(SEVERITIES, start=1))):
        out = F.when(c == s, i).otherwise(out)
    return out


def scanned_bytes(df: DataFrame) -> int:
    """Size of the files behind a table, from file status only."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def plan_preview(
    spark: SparkSession,
    suite: Suite,
    tables: Mapping[str, DataFrame],
    history: DataFrame | None = None,
) -> DataFrame:
    """Per check: bytes behind its dataset and the usual duration from history
    (columns test, duration_ms)."""
    sizes = {name: scanned_bytes(df) for name, df in tables.items()}
    rows = [
        (t.name, t.type, t.dataset, t.severity, t.gate, sizes.get(t.dataset, 0))
        for t in suite.tests
        if t.enabled
    ]
    plan = local_frame(
        spark, rows, "test string, type string, dataset string, severity string, gate string, scan_bytes bigint"
    )
    if history is None:
        return plan.withColumn("seconds", F.lit(None).cast("double"))
    usual = history.groupBy("test").agg((F.median("duration_ms") / 1000).alias("seconds"))
    return plan.join(usual, "test", "left")


# Ranges of a plan's order, by severity and bits of the size; sizes within a factor of
# two share some of 64 ranges.
_FINE = 64


def _range(rank: Column, size: Column) -> Column:
    """A number that never decreases along (rank, size): the rank, the power of two below
    the size, and how far the size is from there to the next."""
    power = F.when(size > 0, F.floor(F.log2(size.cast("double"))).cast("int")).otherwise(F.lit(-1))
    base = F.when(power >= 0, F.pow(F.lit(2.0), power)).otherwise(F.lit(1.0))
    fine = F.least(F.lit(_FINE - 1), F.floor((size / base - 1) * _FINE)).cast("int")
    return (rank * 64 + power + 1) * _FINE + F.when(size > 0, fine).otherwise(F.lit(0))


def running_costs(plan: DataFrame) -> DataFrame:
    """`plan` with rank, used_bytes and used_seconds: costs up to each check, blockers
    first, cheap before dear, then by name.

    The order is cut into ranges of rank and size, and a range in which all checks cost
    the same by the first letters of their names: sums per part, prefixes over the few
    parts, and a window inside each. No task sees the whole plan."""
    ranked = plan.withColumn("rank", severity_rank(F.col("severity"))).withColumns(
        {"_size": F.coalesce("scan_bytes", F.lit(0)), "_seconds": F.coalesce("seconds", F.lit(0.0))}
    )
    ranked = ranked.withColumn("_range", _range(F.col("rank"), F.col("_size")).cast("bigint"))
    costs = [F.sum("_size").alias("_b"), F.sum("_seconds").alias("_s")]
    by_rank = ranked.groupBy("rank").agg(*costs)
    of_rank = by_rank.agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("_b", "_s"))))).scalar()

    def above(field: str, zero: Column) -> Column:
        """Costs of all graver checks."""
        out = zero
        for r in range(1, len(SEVERITIES) + 1):
            cost = F.coalesce(F.element_at(of_rank, r)[field], zero)
            out = out + F.when(F.col("rank") > r, cost).otherwise(zero)
        return out

    one_cost = (F.min("_size") == F.max("_size")).alias("_same")
    # At most 4 ranks, 65 powers of two and 64 steps: a few thousand rows.
    before = W.partitionBy("rank").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ahead = ranked.groupBy("rank", "_range").agg(*costs, one_cost)
    ahead = ahead.select("_range", "_same", *_sums_over(before, "0"))
    cut = ranked.join(F.broadcast(ahead), "_range")
    # Three leading bytes keep the order of names.
    letters = F.conv(F.rpad(F.hex(F.substring(F.col("test").cast("binary"), 1, 3)), 6, "0"), 16, 10).cast("bigint")
    cut = cut.withColumn("_part", F.when(F.col("_same"), F.coalesce(letters, F.lit(-1))).otherwise(F.lit(0)))
    inside = W.partitionBy("_range").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = cut.groupBy("_range", "_part").agg(*costs).select("_range", "_part", *_sums_over(inside, "1"))
    own = W.partitionBy("_range", "_part").orderBy("_size", "test").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = cut.join(parts, ["_range", "_part"])
    used = above("_b", F.lit(0).cast("bigint")) + F.col("_b0") + F.col("_b1") + F.sum("_size").over(own)
    seconds = above("_s", F.lit(0.0)) + F.col("_s0") + F.col("_s1") + F.sum("_seconds").over(own)
    out = out.withColumns({"used_bytes": used, "used_seconds": seconds})
    return out.select(*plan.columns, "rank", "used_bytes", "used_seconds")


def _sums_over(window: WindowSpec, mark: str) -> list[Column]:
    return [
        F.coalesce(F.sum("_b").over(window), F.lit(0)).alias(f"_b{mark}"),
        F.coalesce(F.sum("_s").over(window), F.lit(0.0)).alias(f"_s{mark}"),
    ]


def check_budget(
    plan: DataFrame, scan_bytes: int | None = None, seconds: float | None = None
) -> DataFrame:
    """Blockers first, cheap before dear; `keep` until a budget is used up, and
    `sample_fraction` for what does not fit (what is left of the scan budget over
    the cost)."""
    out = running_costs(plan)
    fits = F.lit(True)
    if scan_bytes is not None:
        fits = fits & (F.col("used_bytes") <= scan_bytes)
    if seconds is not None:
        fits = fits & (F.col("used_seconds") <= seconds)
    left = F.lit(scan_bytes) - (F.col("used_bytes") - F.col("scan_bytes"))
    fraction = F.when(F.col("keep"), 1.0).otherwise(
        F.greatest(F.lit(0.0), left / F.greatest(F.col("scan_bytes"), F.lit(1)))
        if scan_bytes is not None
        else F.lit(0.0)
    )
    return out.withColumn("keep", fits).withColumn("sample_fraction", fraction.cast("double"))


def auto_sample(
    df: DataFrame,
    est_rows: int,
    threshold: int = 1_000_000,
    seed: int = 42,
    by: list[str] | None = None,
) -> DataFrame:
    """The table itself up to the threshold, about `threshold` rows beyond it.

    With `by` the sample is a function of those columns, the same in every run
    and on every cluster; without, it is Spark's seeded sample.
    """
    if est_rows <= threshold:
        return df
    fraction = threshold / est_rows
    if by is None:
        return df.sample(fraction=fraction, seed=seed)
    buckets = 1_000_000
    return df.filter(sample_bucket(by, buckets, seed) < int(fraction * buckets))
