"""Drift of profiles and of category shares."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..verdict import Judgement, Measurement, result, zero
from .aggregates import count_if, rows


def profile_drift_rows(
    profile: DataFrame,
    baseline: DataFrame,
    max_null_rate_change: float = 0.05,
    max_mean_shift: float = 3.0,
    max_distinct_change: float = 0.5,
) -> DataFrame:
    """One row per profiled column with what drifted.

    The mean shift is in baseline deviations (`stddev` of the baseline; where it
    has none, relative to the baseline mean). A column on one side only drifted.
    """
    c, b = profile.alias("c"), baseline.alias("b")
    null_change = F.abs(F.col("c.null_rate") - F.col("b.null_rate"))
    unit = F.when(F.col("b.stddev") > 0, F.col("b.stddev")).otherwise(
        F.when(F.col("b.avg") != 0, F.abs(F.col("b.avg")))
    )
    shift = F.abs(F.col("c.avg") - F.col("b.avg")) / unit
    distinct_change = F.abs(F.col("c.distinct_count") - F.col("b.distinct_count")) / F.greatest(
        F.col("b.distinct_count"), F.lit(1)
    )
    present = F.col("c.column").isNotNull() & F.col("b.column").isNotNull()
    no = F.lit(False)
    return (
        c.join(b, F.col("c.column") == F.col("b.column"), "full_outer")
        .select(
            F.coalesce("c.column", "b.column").alias("column"),
            present.alias("present"),
            null_change.alias("null_rate_change"),
            shift.alias("mean_shift"),
            distinct_change.alias("distinct_change"),
        )
        .withColumn(
            "drifted",
            ~F.col("present")
            | F.coalesce(F.col("null_rate_change") > max_null_rate_change, no)
            | F.coalesce(F.col("mean_shift") > max_mean_shift, no)
            | F.coalesce(F.col("distinct_change") > max_distinct_change, no),
        )
    )


def profile_drift_measurement(profile: DataFrame, baseline: DataFrame, **limits: float) -> Measurement:
    return Measurement(
        profile_drift_rows(profile, baseline, **limits),
        {
            "drifted": count_if(F.col("drifted")),
            "columns": rows(),
            "nulls": F.max("null_rate_change"),
            "shift": F.max("mean_shift"),
            "distinct": F.max("distinct_change"),
        },
        lambda m: Judgement(
            violations=m("drifted"),
            passed=zero(m("drifted")),
            observed=m("drifted"),
            expected=F.lit(0),
            metrics={
                "drifted_columns": m("drifted"),
                "columns": m("columns"),
                "max_null_rate_change": m("nulls"),
                "max_mean_shift": m("shift"),
                "max_distinct_change": m("distinct"),
            },
        ),
    )


def check_profile_drift(
    profile: DataFrame, baseline: DataFrame, *, label: dict | None = None, **limits: float
) -> DataFrame:
    return result("drift", profile_drift_measurement(profile, baseline, **limits), **(label or {}))


def _category(baseline: DataFrame, column: str, bins: int | None) -> Column:
    """The category of a row: for numbers the equal-width bin between the baseline's
    minimum and maximum, otherwise (or with bins=None) the value itself. Null is a
    category of its own."""
    c = F.col(column)
    if bins is None or not isinstance(baseline.schema[column].dataType, T.NumericType):
        return c.cast("string")
    edges = baseline.agg(
        F.struct(
            F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")
        ).alias("edges")
    ).scalar()
    lo, hi = edges["lo"], edges["hi"]
    step = F.floor((c.cast("double") - lo) / (hi - lo) * bins)
    # A baseline of one value has one bin; what lies below or above it stays apart.
    single = F.when(c < lo, -1).when(c > lo, bins).otherwise(0)
    bin_ = F.when(hi > lo, F.greatest(F.lit(-1), F.least(F.lit(bins), step))).otherwise(single)
    return F.when(c.isNotNull(), bin_).cast("string")


def category_shares(
    df: DataFrame, baseline: DataFrame, column: str, bins: int | None = 10
) -> DataFrame:
    """Counts per category on both sides: (category, current, base). bins=None takes
    numbers as categories."""
    category = _category(baseline, column, bins).alias("category")
    cur = df.select(category, F.lit(1).alias("c"), F.lit(0).alias("b"))
    base = baseline.select(category, F.lit(0).alias("c"), F.lit(1).alias("b"))
    return (
        cur.unionByName(base)
        .groupBy("category")
        .agg(F.sum("c").alias("current"), F.sum("b").alias("base"))
    )


def category_drift_measurement(
    df: DataFrame,
    baseline: DataFrame,
    column: str,
    threshold: float = 0.2,
    bins: int | None = 10,
    floor: float = 1e-4,
) -> Measurement:
    """Population stability index; empty shares count as `floor`."""
    counts = category_shares(df, baseline, column, bins)
    totals = counts.agg(
        F.struct(F.sum("current").alias("c"), F.sum("base").alias("b")).alias("t")
    ).scalar()
    p = F.greatest(F.col("current") / totals["c"], F.lit(floor))
    q = F.greatest(F.col("base") / totals["b"], F.lit(floor))
    shares = counts.select("category", "current", "base", p.alias("p"), q.alias("q"))
    return Measurement(
        shares,
        {
            "psi": F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))),
            "categories": rows(),
            "appeared": F.count_if(F.col("base") == 0),
            "vanished": F.count_if(F.col("current") == 0),
        },
        lambda m: Judgement(
            violations=F.when(m("psi") <= threshold, 0).otherwise(1),
            passed=m("psi") <= threshold,
            observed=m("psi"),
            expected=F.lit(0),
            tolerance=F.lit(threshold),
            metrics={
                "psi": m("psi"),
                "categories": m("categories"),
                "appeared": m("appeared"),
                "vanished": m("vanished"),
            },
        ),
    )


def check_category_drift(
    df: DataFrame,
    baseline: DataFrame,
    column: str,
    threshold: float = 0.2,
    bins: int | None = 10,
    floor: float = 1e-4,
    **label: Any,
) -> DataFrame:
    m = category_drift_measurement(df, baseline, column, threshold, bins, floor)
    return result("drift", m, **label)
