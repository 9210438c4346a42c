"""Freshness, row counts, totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import farther, farther_by_share, is_float
from ..functions.times import hours_crossed, hours_elapsed, moment, utc
from ..verdict import Judgement, Measurement, result, zero
from .aggregates import ir_aggregate, rows


def freshness_judgement(
    newest: Column, total: Column, last_hours: int, as_of: Any, elapsed: bool
) -> Judgement:
    lag_of = hours_elapsed if elapsed else hours_crossed
    lag = lag_of(newest, moment(as_of))
    empty = newest.isNull()
    return Judgement(
        violations=F.when(empty, F.lit(1)).otherwise(F.greatest(F.lit(0), lag - last_hours)),
        passed=lag <= last_hours,
        observed=lag,
        expected=F.lit(last_hours),
        tolerance=F.lit(0),
        metrics={
            "hours_lag": lag,
            "max_hours_allowed": F.lit(last_hours),
            "max_timestamp": newest,
            "total_rows": total,
        },
        message=F.when(empty, F.lit("No data found")),
    )


def fresh_measurement(
    df: DataFrame, ts: str | Column, last_hours: int | None = 24, as_of: Any = None, elapsed: bool = False
) -> Measurement:
    hours = 24 if last_hours is None else last_hours
    c = F.col(ts) if isinstance(ts, str) else ts
    kind = df.schema[ts].dataType if isinstance(ts, str) else df.select(ts).schema[0].dataType
    return Measurement(
        df,
        {"newest": F.max(c), "total": rows()},
        lambda m: freshness_judgement(utc(m("newest"), kind), m("total"), hours, as_of, elapsed),
    )


def check_fresh(
    df: DataFrame,
    ts: str,
    last_hours: int = 24,
    as_of: Any = None,
    elapsed: bool = False,
    **label: Any,
) -> DataFrame:
    return result("freshness", fresh_measurement(df, ts, last_hours, as_of, elapsed), **label)


def row_count_measurement(
    df: DataFrame, minimum: int | None = None, maximum: int | None = None
) -> Measurement:
    def judge(m: Any) -> Judgement:
        below = F.lit(0) if minimum is None else F.greatest(F.lit(0), F.lit(minimum) - m("n"))
        above = F.lit(0) if maximum is None else F.greatest(F.lit(0), m("n") - F.lit(maximum))
        return Judgement(
            violations=below + above,
            passed=zero(below + above),
            observed=m("n"),
            expected=F.lit(minimum if minimum is not None else maximum),
            metrics={"row_count": m("n")},
        )

    return Measurement(df, {"n": rows()}, judge)


def check_row_count(
    df: DataFrame, minimum: int | None = None, maximum: int | None = None, **label: Any
) -> DataFrame:
    return result("row_count", row_count_measurement(df, minimum, maximum), **label)


def stable_count_measurement(df: DataFrame, baseline: int | Column, pct: float = 10.0) -> Measurement:
    """`baseline` may be a number or a scalar-subquery column."""
    base = F.lit(baseline) if not isinstance(baseline, Column) else baseline

    def judge(m: Any) -> Judgement:
        diff = F.abs(m("n") - base)
        change = F.when(base != 0, diff * 100 / base).when(diff == 0, 0.0)
        ok = F.coalesce(change <= pct, F.lit(False))
        return Judgement(
            violations=F.when(ok, 0).otherwise(diff),
            passed=ok,
            observed=m("n"),
            expected=base,
            tolerance=F.lit(pct),
            metrics={"row_count": m("n"), "baseline": base, "change_pct": change},
        )

    return Measurement(df, {"n": rows()}, judge)


def check_row_count_stable(
    df: DataFrame, baseline: int | Column, pct: float = 10.0, **label: Any
) -> DataFrame:
    return result("row_count_stable", stable_count_measurement(df, baseline, pct), **label)


def within(
    actual: Column,
    expected: Column,
    abs_tol: float,
    pct: float | None,
    numeric: bool = True,
    floating: bool = False,
) -> Column:
    """Close enough by the absolute or, if given, by the percentage tolerance, compared in
    the type of both sides; anything but numbers has to be equal. Equal nulls agree; one
    missing side never does."""
    if numeric:
        ok = ~farther(actual, expected, abs_tol, floating)
        if pct is not None:
            ok = ok | ((expected != 0) & ~farther_by_share(actual, expected, pct, floating))
    else:
        ok = actual == expected
    return F.when(actual.isNull() & expected.isNull(), True).otherwise(
        F.coalesce(ok, F.lit(False))
    )


def count_match_measurement(
    a: DataFrame, b: DataFrame, abs_tol: int = 0, pct: float = 0.0
) -> Measurement:
    none = F.lit(None).cast("bigint")
    counts = a.agg(rows().alias("a"), none.alias("b")).unionByName(
        b.agg(none.alias("a"), rows().alias("b"))
    )

    def judge(m: Any) -> Judgement:
        diff = F.abs(m("a") - m("b"))
        ok = within(m("a"), m("b"), abs_tol, pct)
        return Judgement(
            violations=F.when(ok, 0).otherwise(diff),
            passed=ok,
            observed=m("a"),
            expected=m("b"),
            tolerance=F.lit(abs_tol),
            metrics={"row_count": m("a"), "other_count": m("b"), "difference": diff},
        )

    return Measurement(counts, {"a": F.max("a"), "b": F.max("b")}, judge)


def check_count_match(
    a: DataFrame, b: DataFrame, abs_tol: int = 0, pct: float = 0.0, **label: Any
) -> DataFrame:
    return result("count_match", count_match_measurement(a, b, abs_tol, pct), **label)


Metrics = Mapping[str, tuple[str, str]]


def agg_match_frame(
    df: DataFrame,
    source: DataFrame,
    metrics: Metrics,
    group_by: Sequence[str] = (),
    abs_tol: float = 0.01,
    pct: float | None = None,
) -> DataFrame:
    """Both sides aggregated first, then compared: one row per group with
    `<metric>_actual`, `<metric>_expected`, `<metric>_ok` and `present`
    (both, actual_only, expected_only). Metrics keep the type of their aggregate: whole
    numbers, decimals and times are not turned into doubles."""
    group_by = list(group_by)
    left = ir_aggregate(df, metrics, group_by, own_types=True)
    right = ir_aggregate(source, metrics, group_by, own_types=True)
    kinds = {m: [side.schema[m].dataType for side in (left, right)] for m in metrics}
    numeric = {m: all(isinstance(k, T.NumericType) for k in both) for m, both in kinds.items()}
    a = left.select(
        *[F.col(g).alias(f"a_{g}") for g in group_by],
        F.lit(1).alias("_a"),
        *[F.col(m).alias(f"{m}_actual") for m in metrics],
    )
    b = right.select(
        *[F.col(g).alias(f"b_{g}") for g in group_by],
        F.lit(1).alias("_b"),
        *[F.col(m).alias(f"{m}_expected") for m in metrics],
    )
    if group_by:
        cond = reduce(
            lambda x, y: x & y, [F.col(f"a_{g}").eqNullSafe(F.col(f"b_{g}")) for g in group_by]
        )
        joined = a.join(b, cond, "full_outer")
    else:
        # Two single rows: put side by side by a maximum instead of a join.
        stacked = a.unionByName(b, allowMissingColumns=True)
        joined = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.select(
        *[F.coalesce(F.col(f"a_{g}"), F.col(f"b_{g}")).alias(g) for g in group_by],
        F.when(both, "both").when(F.col("_a").isNotNull(), "actual_only").otherwise("expected_only").alias("present"),
        *[
            c
            for m in metrics
            for c in (
                F.col(f"{m}_actual"),
                F.col(f"{m}_expected"),
                (
                    both
                    & within(
                        F.col(f"{m}_actual"), F.col(f"{m}_expected"), abs_tol, pct, numeric[m], is_float(*kinds[m])
                    )
                ).alias(f"{m}_ok"),
            )
        ],
    )


def agg_match_measurement(
    df: DataFrame,
    source: DataFrame,
    metrics: Metrics,
    group_by: Sequence[str] = (),
    abs_tol: float = 0.01,
    pct: float | None = None,
) -> Measurement:
    frame = agg_match_frame(df, source, metrics, group_by, abs_tol, pct)
    off = reduce(
        lambda x, y: x + y, [F.when(F.col(f"{m}_ok"), 0).otherwise(1) for m in metrics]
    )
    return Measurement(
        frame,
        {
            "off": F.coalesce(F.sum(off), F.lit(0)),
            "groups": rows(),
            "missing": F.count_if(F.col("present") != "both"),
        },
        lambda m: Judgement(
            violations=m("off"),
            passed=zero(m("off")),
            observed=m("off"),
            expected=F.lit(0),
            tolerance=F.lit(abs_tol),
            metrics={
                "compared_groups": m("groups"),
                "missing_groups": m("missing"),
                "mismatches": m("off"),
            },
        ),
    )


def check_agg_match(
    df: DataFrame,
    source: DataFrame,
    metrics: Metrics,
    group_by: Sequence[str] = (),
    abs_tol: float = 0.01,
    pct: float | None = None,
    **label: Any,
) -> DataFrame:
    m = agg_match_measurement(df, source, metrics, group_by, abs_tol, pct)
    return result("agg_match", m, **label)
