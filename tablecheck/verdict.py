"""From aggregates to verdicts.

A check is described by a `Measurement`: aggregate expressions over one frame
and a rule that turns the aggregated values into a `Judgement`.  Everything
stays lazy.  Measurements over the same frame are evaluated by ONE `agg`, so any
number of them costs one scan; `evaluate` then unfolds the single aggregate row
into one result row per check.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .functions.times import moment
from .spec import Check, RESULT_SCHEMA


@dataclass(frozen=True)
class Judgement:
    violations: Column
    passed: Column
    observed: Column | None = None
    expected: Column | None = None
    tolerance: Column | None = None
    metrics: Mapping[str, Column] = field(default_factory=dict)
    message: Column | None = None


@dataclass(frozen=True)
class Measurement:
    frame: DataFrame
    measures: Mapping[str, Column]
    judge: Callable[[Callable[[str], Column]], Judgement]


@dataclass(frozen=True)
class RunContext:
    run_id: str = "adhoc"
    suite: str = "adhoc"
    as_of: Any = None


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _line(check: Check, j: Judgement) -> Column:
    """One check's part of the result. Types are settled once for all lines by
    the array they go into and the cast after it, which keeps the number of
    expressions per check small."""
    none = F.lit(None)
    label = ", ".join(
        f"'{k}', {_sql_text(getattr(check, a))}"
        for k, a in (
            ("test", "name"),
            ("type", "type"),
            ("dataset", "dataset"),
            ("severity", "severity"),
            ("gate", "gate"),
        )
    )
    metrics = [x for k, v in j.metrics.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.expr(f"named_struct({label})").alias("label"),
        F.when(j.passed, "pass").otherwise("fail").alias("status"),
        j.violations.cast("bigint").alias("violations"),
        *[
            (none if c is None else c).cast("double").alias(name)
            for name, c in (
                ("observed", j.observed),
                ("expected", j.expected),
                ("tolerance", j.tolerance),
            )
        ],
        (F.create_map(*metrics) if metrics else none).cast("map<string,string>").alias("metrics"),
        (none if j.message is None else j.message).cast("string").alias("error_message"),
    )


def analyse(m: Measurement) -> None:
    """Raises if the measures do not fit the frame; runs nothing."""
    m.frame.agg(*[c.alias(name) for name, c in m.measures.items()])


def evaluate(
    items: Sequence[tuple[Check, Measurement]], ctx: RunContext = RunContext()
) -> DataFrame:
    """Result rows for measurements that share one frame: one scan, one `agg`."""
    frame = items[0][1].frame
    aggregates, lines = [], []
    for i, (check, m) in enumerate(items):
        if m.frame is not frame:
            raise ValueError("evaluate() needs measurements over one frame")
        aggregates += [c.alias(f"m{i}_{name}") for name, c in m.measures.items()]
        lines.append(_line(check, m.judge(lambda name, i=i: F.col(f"m{i}_{name}"))))
    return (
        frame.agg(*aggregates)
        .select(F.inline(F.array(*lines)))
        .select(
            F.lit(ctx.run_id).alias("run_id"),
            F.lit(ctx.suite).alias("suite"),
            "label.*",
            *[
                f.name
                for f in RESULT_SCHEMA.fields
                if f.name
                not in ("run_id", "suite", "test", "type", "dataset", "severity", "gate", "as_of")
            ],
            moment(ctx.as_of).alias("as_of"),
        )
    )


def evaluate_one(check: Check, m: Measurement, ctx: RunContext = RunContext()) -> DataFrame:
    return evaluate([(check, m)], ctx)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def zero(violations: Column) -> Column:
    return violations == 0


def result(
    kind: str,
    m: Measurement,
    *,
    name: str | None = None,
    dataset: str = "-",
    severity: str = "major",
    gate: str = "fail",
    ctx: RunContext = RunContext(),
) -> DataFrame:
    """One-row result for a check called directly, outside any suite."""
    check = Check(name or kind, kind, dataset, severity=severity, gate=gate)
    return evaluate_one(check, m, ctx)
