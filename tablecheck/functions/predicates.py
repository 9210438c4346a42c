"""Row predicates: filters, windows and business rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..spec import Check, Filter, Window
from .times import interval, moment

_OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
}


def names_where(conditions: Iterable[tuple[str, Column]]) -> Column:
    """The names whose condition is true. Put together from constant arrays, which is
    compiled; a lambda over an array, as in `array_compact`, is interpreted row by row."""
    none = F.array().cast("array<string>")
    parts = [F.when(c, F.array(F.lit(name))).otherwise(none) for name, c in conditions]
    return F.concat(*parts) if parts else none


def filter_predicate(f: Filter) -> Column:
    if f.operator not in _OPERATORS:
        raise ValueError(f"unknown filter operator {f.operator!r}")
    return _OPERATORS[f.operator](F.col(f.column), f.value)


def apply_filters(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """All filters hold; SQL null logic, so `not_in` drops null rows."""
    for f in filters:
        df = df.filter(filter_predicate(f))
    return df


def window_last(
    df: DataFrame, column: str, days: int = 0, hours: int = 0, as_of: Any = None
) -> DataFrame:
    """The trailing period that ends at `as_of`, both ends included."""
    if not days and not hours:
        raise ValueError("window_last needs days or hours")
    if days and not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    if hours and not 1 <= hours <= 8760:
        raise ValueError("hours must be between 1 and 8760")
    end = moment(as_of)
    c = F.col(column)
    return df.filter((c >= end - interval(days=days, hours=hours)) & (c <= end))


def window_batch(df: DataFrame, column: str, batch_id: Any) -> DataFrame:
    return df.filter(F.col(column) == batch_id)


def window_range(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Half-open range [start, end)."""
    if start is not None:
        df = df.filter(F.col(column) >= moment(start))
    if end is not None:
        df = df.filter(F.col(column) < moment(end))
    return df


def apply_window(
    df: DataFrame,
    window: Window | None,
    watermark: str | None,
    batch_column: str | None = None,
    as_of: Any = None,
) -> DataFrame:
    if window is None:
        return df
    trailing = window.last_days or window.last_hours
    ranged = window.start_date is not None or window.end_date is not None
    if (trailing or ranged) and watermark is None:
        raise ValueError("a time window needs a watermark column")
    if window.batch_id is not None and batch_column is None:
        raise ValueError("a batch window needs a batch column")
    if trailing:
        df = window_last(df, watermark, window.last_days or 0, window.last_hours or 0, as_of)
    if ranged:
        df = window_range(df, watermark, window.start_date, window.end_date)
    if window.batch_id is not None:
        df = window_batch(df, batch_column, window.batch_id)
    return df


def rule_sides(expression: str) -> tuple[Column, Column] | None:
    """Both sides of a rule whose top node is an equality, else None. Spark's own parser
    says what the top node is: `a == b AND a > 0` and `t == 'x == y'` are not taken apart."""
    spark = SparkSession.active()
    node = spark._jsparkSession.sessionState().sqlParser().parseExpression(expression)
    if node.nodeName() != "EqualTo":
        return None
    return F.expr(node.left().sql()), F.expr(node.right().sql())


def number(value: Any) -> Column:
    """A tolerance as the decimal that it is written as: next to whole numbers and
    decimals it stays exact, next to doubles it is a double."""
    return F.lit(Decimal(str(value)))


def is_float(*kinds: T.DataType) -> bool:
    return any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds)


def _decided(left: Column, right: Column, measure: Callable, floating: bool, band: float) -> Column:
    """`measure(left, right)` as a comparison, in the type of both sides. Doubles stand
    for the decimals that they are written as: where rounding could decide, within
    `band` of their size, those decimals are compared instead."""
    above, limit = measure(left, right)
    if not floating:
        return above > limit
    fixed = [c.cast("double").cast("string").try_cast("decimal(38,18)") for c in (left, right)]
    exact_above, exact_limit = measure(*fixed)
    room = F.lit(band) * (F.abs(left) + F.abs(right))
    clear = F.abs(above - limit) > room
    return F.when(clear, above > limit).otherwise(F.coalesce(exact_above > exact_limit, above > limit))


def farther(left: Column, right: Column, abs_tol: float, floating: bool) -> Column:
    """Whether two numbers lie farther apart than `abs_tol`; null if one is null."""
    return _decided(left, right, lambda a, b: (F.abs(a - b), number(abs_tol)), floating, 1e-15)


def farther_by_share(left: Column, right: Column, pct: float, floating: bool) -> Column:
    """Whether they lie farther apart than `pct` percent of the second."""
    band = 1e-13 + 1e-15 * float(pct)
    return _decided(
        left, right, lambda a, b: (F.abs(a - b) * number(100), number(pct) * F.abs(b)), floating, band
    )


def exceeds(left: Column, right: Column, abs_tol: float, pct: float | None = None, floating: bool = True) -> Column:
    """Difference beyond the absolute and, if given, the percentage tolerance."""
    out = farther(left, right, abs_tol, floating)
    return out if pct is None else out & farther_by_share(left, right, pct, floating)


def rule_predicate(
    df: DataFrame, expression: str, abs_tol: float = 0.01, pct: float | None = None
) -> Column:
    """True where a row of `df` breaks the rule, null where it cannot be decided.

    `a == b + c` between numbers means equal within tolerance, between other types equal;
    any other text is a condition that must hold.
    """
    sides = rule_sides(expression)
    if sides is None:
        return ~F.expr(expression)
    kinds = [f.dataType for f in df.select(*[s.alias(f"s{i}") for i, s in enumerate(sides)]).schema]
    if not all(isinstance(k, T.NumericType) for k in kinds):
        return ~F.expr(expression)
    return exceeds(*sides, abs_tol, pct, is_float(*kinds))


def scope(
    tests: Sequence[Check],
    layer: str | None = None,
    dataset: str | None = None,
    pattern: str | None = None,
    tags: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
) -> list[Check]:
    """Choose checks by layer, dataset, name pattern (regex on dataset), tag or name."""
    import re

    from ..plans.proposals import layer_of

    return [
        t
        for t in tests
        if (layer is None or layer_of(t.dataset) == layer.upper())
        and (dataset is None or t.dataset == dataset)
        and (pattern is None or re.search(pattern, t.dataset))
        and (tags is None or set(tags) & set(t.tags))
        and (names is None or t.name in names)
    ]


def scope_rows(
    df: DataFrame,
    dataset: str | None = None,
    pattern: str | None = None,
    tags: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """`scope` for suites or catalogs held as rows (columns dataset, test, tags)."""
    if dataset is not None:
        df = df.filter(F.col("dataset") == dataset)
    if pattern is not None:
        df = df.filter(F.col("dataset").rlike(pattern))
    if tags is not None:
        df = df.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if names is not None:
        df = df.filter(F.col("test").isin(list(names)))
    return df
