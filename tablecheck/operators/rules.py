"""Business rules: `a == b + c` within tolerance, or any condition."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.predicates import rule_predicate, rule_sides
from ..verdict import Judgement, Measurement, result, zero
from .aggregates import count_if, rows, total


def rule_rows(
    df: DataFrame, expression: str, abs_tol: float = 0.01, pct: float | None = None
) -> DataFrame:
    """Rows that break the rule; an undecidable (null) rule is not broken."""
    return df.filter(rule_predicate(df, expression, abs_tol, pct))


def rule_measurement(
    df: DataFrame, expression: str, abs_tol: float = 0.01, pct: float | None = None
) -> Measurement:
    bad = rule_predicate(df, expression, abs_tol, pct)
    sides = rule_sides(expression)
    diff = F.max(F.lit(None).cast("double"))
    if sides is not None:
        left, right = (df.select(s.alias("s")).schema["s"].dataType for s in sides)
        if isinstance(left, T.NumericType) and isinstance(right, T.NumericType):
            apart = F.abs(sides[0] - sides[1])
            diff = total(F.when(bad, apart), df.select(apart.alias("d")).schema["d"].dataType)
    measures = {
        "bad": count_if(bad),
        "unknown": F.count_if(bad.isNull()),
        "total": rows(),
        "diff": diff,
    }
    return Measurement(
        df,
        measures,
        lambda m: Judgement(
            violations=m("bad"),
            passed=zero(m("bad")),
            observed=m("bad"),
            expected=F.lit(0),
            tolerance=F.lit(float(abs_tol)),
            metrics={
                "violation_count": m("bad"),
                "avg_difference": F.when(m("bad") > 0, m("diff") / m("bad")),
                "unknown_rows": m("unknown"),
                "total_rows": m("total"),
            },
        ),
    )


def check_rule(
    df: DataFrame,
    expression: str,
    abs_tol: float = 0.01,
    pct: float | None = None,
    **label: Any,
) -> DataFrame:
    return result("rule", rule_measurement(df, expression, abs_tol, pct), **label)
