"""Reconciling a table with evidence supplied by its source: expected row count,
control totals, sample keys, contract, checksum."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import payloads as P
from ..functions.hashing import checksum
from ..functions.predicates import farther, farther_by_share, is_float, window_range
from ..verdict import Judgement, Measurement, result, zero
from .aggregates import number_sum, rows, type_of
from .contracts import schema_differences
from .distinct import distinct_counts
from .payload import parsed

ROWCOUNT = "rowcount"


@dataclass(frozen=True)
class EvidenceWindow:
    column: str
    start: Any
    end: Any


@dataclass(frozen=True)
class Manifest:
    batch_id: str
    expected_rowcount: int
    control_totals: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class EvidenceTolerance:
    rowcount_abs: float = 0
    rowcount_pct: float = 0.0
    totals_pct: float = 0.5
    totals_abs: float = 0.0


def total_name(key: str) -> str:
    """SUM(amount) and SUM_amount are both sum_amount."""
    return re.sub(r"\W+", "_", key).strip("_").lower()


def total_column(df: DataFrame, key: str) -> Column:
    """The aggregate behind a control total: SUM, DISTINCT, MIN or MAX of a
    column, or any other aggregate expression."""
    found = re.fullmatch(r"(SUM|DISTINCT|MIN|MAX)(?:\((\w+)\)|_(\w+))", key, re.IGNORECASE)
    if not found:
        return F.expr(key)
    fn, column = found.group(1).upper(), found.group(2) or found.group(3)
    if fn == "SUM":
        return number_sum(df, column)
    if fn == "DISTINCT":
        return F.count_distinct(F.col(column))
    return F.min(column) if fn == "MIN" else F.max(column)


def in_window(df: DataFrame, window: EvidenceWindow | None) -> DataFrame:
    return df if window is None else window_range(df, window.column, window.start, window.end)


def _distinct_column(key: str) -> str | None:
    found = re.fullmatch(r"DISTINCT(?:\((\w+)\)|_(\w+))", key, re.IGNORECASE)
    return (found.group(1) or found.group(2)) if found else None


def evidence_metrics(
    df: DataFrame,
    window: EvidenceWindow | None,
    totals: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Row count and control totals of a window: one filter, one aggregate. Several
    DISTINCT totals are one more pass over reduced (column, value) pairs."""
    rows_in = in_window(df, window)
    distinct = {total_name(t): c for t in totals if (c := _distinct_column(t))}
    if len(distinct) < 2:
        distinct = {}
    cols = [rows().alias(ROWCOUNT)]
    cols += [total_column(df, t).alias(total_name(t)) for t in totals if total_name(t) not in distinct]
    measured = rows_in.groupBy(*by).agg(*cols) if by else rows_in.agg(*cols)
    if not distinct:
        return measured
    counts = distinct_counts(rows_in, {n: F.col(c) for n, c in distinct.items()}, by)
    if by:
        counts = counts.select(*[F.col(c).alias(f"_d_{c}") for c in by], "counts")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in by])
        measured = measured.join(counts, same, "left")
    else:
        measured = measured.withColumn("counts", counts.scalar())
    found = {n: F.coalesce(F.element_at("counts", n), F.lit(0)).cast("bigint") for n in distinct}
    return measured.withColumns(found).select(*by, ROWCOUNT, *[total_name(t) for t in totals])


def _literal(value: Any, data_type: T.DataType) -> Column:
    """An expected value, exact where the actual one is: 45.2 and "45.2" are decimals
    next to whole numbers and decimals."""
    if not isinstance(data_type, T.NumericType) or value is None or isinstance(value, (bool, Column)):
        return F.lit(value)
    if is_float(data_type) and not isinstance(value, str):
        return F.lit(value)
    try:
        return F.lit(Decimal(str(value)))
    except ArithmeticError:
        return F.lit(None).cast(data_type)


def _compare(
    metric: str,
    actual: Column,
    data_type: T.DataType,
    expected: Column,
    tol: EvidenceTolerance,
    expected_type: T.DataType | None = None,
) -> Column:
    """One report line. Nothing is compared as text: a number is compared with a number,
    in their own types, anything else takes the type of the actual value. An expected 0
    has no percentage, so only the absolute tolerance can excuse it."""
    none = F.lit(None).cast("double")
    both = actual.isNotNull() & expected.isNotNull()
    shown = expected.cast("string")
    if isinstance(data_type, T.NumericType):
        if isinstance(expected_type, T.StringType):
            expected = expected.try_cast("double" if is_float(data_type) else "decimal(38,18)")
            both = both & expected.isNotNull()
        floating = is_float(data_type) or expected_type is None or is_float(expected_type)
        apart = F.abs(actual - expected).cast("double")
        diff, size = apart, F.abs(expected).cast("double")
        pct = F.when(expected != 0, diff / size * 100)
        if metric == ROWCOUNT:
            limits = (tol.rowcount_abs, tol.rowcount_pct)
            near = ~farther(actual, expected, limits[0], floating)
            ok = near | ((expected != 0) & ~farther_by_share(actual, expected, limits[1], floating))
        else:
            ok = F.when(expected != 0, ~farther_by_share(actual, expected, tol.totals_pct, floating)).otherwise(
                ~farther(actual, expected, tol.totals_abs, floating)
            )
    else:
        diff = pct = none
        ok = actual == expected.try_cast(data_type)
    return F.struct(
        F.lit(metric).alias("metric"),
        actual.cast("string").alias("actual"),
        shown.alias("expected"),
        diff.alias("abs_diff"),
        pct.alias("pct_diff"),
        F.coalesce(both & ok, F.lit(False)).alias("within"),
    )


def reconcile_evidence(
    df: DataFrame,
    window: EvidenceWindow | None,
    manifest: Manifest,
    tol: EvidenceTolerance = EvidenceTolerance(),
) -> DataFrame:
    """Long report: metric, actual, expected, abs_diff, pct_diff, within."""
    measured = evidence_metrics(df, window, list(manifest.control_totals))
    expected = {ROWCOUNT: manifest.expected_rowcount}
    expected |= {total_name(k): v for k, v in manifest.control_totals.items()}
    lines = []
    for name, value in expected.items():
        kind = measured.schema[name].dataType
        wanted = _literal(value, kind)
        lines.append(_compare(name, F.col(name), kind, wanted, tol, measured.select(wanted.alias("e")).schema["e"].dataType))
    return measured.select(F.inline(F.array(*lines)))


def evidence_measurement(
    df: DataFrame,
    window: EvidenceWindow | None,
    manifest: Manifest,
    tol: EvidenceTolerance = EvidenceTolerance(),
) -> Measurement:
    return Measurement(
        reconcile_evidence(df, window, manifest, tol),
        {
            "off": F.count_if(~F.col("within")),
            "n": rows(),
            "actual": F.max(F.when(F.col("metric") == ROWCOUNT, F.col("actual"))),
        },
        lambda m: Judgement(
            violations=m("off"),
            passed=zero(m("off")),
            observed=m("actual"),
            expected=F.lit(manifest.expected_rowcount),
            tolerance=F.lit(float(tol.totals_pct)),
            metrics={"compared": m("n"), "mismatches": m("off"), "row_count": m("actual")},
        ),
    )


def check_evidence(
    df: DataFrame,
    window: EvidenceWindow | None,
    manifest: Manifest,
    tol: EvidenceTolerance = EvidenceTolerance(),
    **label: Any,
) -> DataFrame:
    return result("reconciliation", evidence_measurement(df, window, manifest, tol), **label)


def reconcile_batches(
    df: DataFrame,
    batch_column: str,
    manifests: DataFrame,
    totals: Sequence[str],
    tol: EvidenceTolerance = EvidenceTolerance(),
) -> DataFrame:
    """All batches in one job. `manifests` has `batch_id`, `rowcount` and one
    column per control total, named by `total_name`. A batch on one side only
    fails on every metric."""
    names = [ROWCOUNT, *[total_name(t) for t in totals]]
    measured = evidence_metrics(df, None, totals, by=[batch_column])
    a = measured.select(F.col(batch_column).alias("_batch"), *names).alias("a")
    e = manifests.select("batch_id", *names).alias("e")
    lines = [
        _compare(n, F.col(f"a.{n}"), measured.schema[n].dataType, F.col(f"e.{n}"), tol, manifests.schema[n].dataType)
        for n in names
    ]
    return a.join(e, F.col("a._batch") == F.col("e.batch_id"), "full_outer").select(
        F.coalesce("a._batch", "e.batch_id").alias("batch_id"), F.inline(F.array(*lines))
    )


def missing_evidence_keys(
    df: DataFrame, key: str, sample_keys: DataFrame, sample_column: str = "key", masked: bool = False
) -> DataFrame:
    """Sample keys the table does not have. With `masked` the samples are
    SHA-256 of the key. The table is first cut down to sampled keys, so when the
    sample is small enough to be broadcast the table itself is not shuffled."""
    value = F.sha2(F.col(key).cast("string"), 256) if masked else F.col(key)
    wanted = sample_keys.select(F.col(sample_column).alias("s")).filter(F.col("s").isNotNull())
    wanted = wanted.distinct()
    present = df.select(value.alias("k"))
    found = present.join(wanted, F.col("k") == F.col("s"), "left_semi").distinct()
    return wanted.join(found, F.col("s") == F.col("k"), "left_anti").select(
        F.col("s").alias(sample_column)
    )


def evidence_keys_measurement(
    df: DataFrame, key: str, sample_keys: DataFrame, sample_column: str = "key", masked: bool = False
) -> Measurement:
    return Measurement(
        missing_evidence_keys(df, key, sample_keys, sample_column, masked),
        {"n": rows()},
        lambda m: Judgement(
            violations=m("n"),
            passed=zero(m("n")),
            observed=m("n"),
            expected=F.lit(0),
            metrics={"missing_keys": m("n")},
        ),
    )


def check_evidence_keys(
    df: DataFrame,
    key: str,
    sample_keys: DataFrame,
    sample_column: str = "key",
    masked: bool = False,
    **label: Any,
) -> DataFrame:
    m = evidence_keys_measurement(df, key, sample_keys, sample_column, masked)
    return result("reconciliation", m, **label)


def evidence_contract_measurement(
    df: DataFrame,
    fields: Sequence[tuple[str, str, bool | None]] = (),
    payload: str | None = None,
    paths: Mapping[str, str] | None = None,
    keys: Sequence[str] = (),
) -> Measurement:
    """Required columns and types, null-free keys, required JSON paths with type
    hints. Violations: schema differences plus rows that miss or mistype."""
    from ..plans.catalog import contract_frame, table_schema

    spark = df.sparkSession
    measures: dict[str, Column] = {"total": rows()}
    bad: list[str] = []
    if fields:
        diff = schema_differences(table_schema(df), contract_frame(spark, fields), allow_extra=True)
        measures["schema"] = F.first(diff.agg(rows().alias("n")).scalar())
        bad.append("schema")
    for k in keys:
        measures[f"null_{k}"] = F.count_if(F.col(k).isNull())
        bad.append(f"null_{k}")
    for i, (path, expected) in enumerate((paths or {}).items()):
        v = P.at(parsed(df, payload), path)
        there = F.col(payload).isNotNull()
        measures[f"missing_{i}"] = F.count_if(there & v.isNull())
        measures[f"mistyped_{i}"] = F.count_if(P.type_class(v) != expected.upper())
        bad += [f"missing_{i}", f"mistyped_{i}"]

    def judge(m: Any) -> Judgement:
        total = F.lit(0)
        for name in bad:
            total = total + m(name)
        return Judgement(
            violations=total,
            passed=zero(total),
            observed=total,
            expected=F.lit(0),
            metrics={"total_rows": m("total"), **{name: m(name) for name in bad}},
        )

    return Measurement(df, measures, judge)


def contract_rows(
    df: DataFrame,
    fields: Sequence[tuple[str, str, bool | None]] = (),
    payload: str | None = None,
    paths: Mapping[str, str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows that break the contract by a null key or a path that is missing or mistyped,
    with `broken`. What the schema lacks is no row."""
    wrong = [F.when(F.col(k).isNull(), F.lit(f"null {k}")) for k in keys]
    for path, expected in (paths or {}).items():
        v = P.at(parsed(df, payload), path)
        wrong.append(F.when(F.col(payload).isNotNull() & v.isNull(), F.lit(f"missing {path}")))
        wrong.append(F.when(P.type_class(v) != expected.upper(), F.lit(f"mistyped {path}")))
    broken = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
    return df.withColumn("broken", broken).filter(F.size("broken") > 0)


def check_evidence_contract(df: DataFrame, *, label: dict | None = None, **contract: Any) -> DataFrame:
    return result("schema", evidence_contract_measurement(df, **contract), **(label or {}))


def evidence_checksum_measurement(
    df: DataFrame, window: EvidenceWindow | None, columns: Sequence[str], expected: str
) -> Measurement:
    def judge(m: Any) -> Judgement:
        same = m("sum") == F.lit(expected)
        return Judgement(
            violations=F.when(same, 0).otherwise(1),
            passed=same,
            metrics={"checksum": m("sum"), "expected": F.lit(expected), "row_count": m("n")},
        )

    return Measurement(in_window(df, window), {"sum": checksum(columns), "n": rows()}, judge)


def check_evidence_checksum(
    df: DataFrame,
    window: EvidenceWindow | None,
    columns: Sequence[str],
    expected: str,
    **label: Any,
) -> DataFrame:
    m = evidence_checksum_measurement(df, window, columns, expected)
    return result("reconciliation", m, **label)
