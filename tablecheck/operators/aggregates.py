"""Aggregate expressions shared by checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

AGGREGATES = ("count", "count_distinct", "sum", "min", "max", "avg")


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.select(F.expr(column) if column not in df.columns else F.col(column)).schema[0].dataType


def rows() -> Column:
    return F.count(F.lit(1))


def count_if(p: Column) -> Column:
    """Number of rows for which the predicate is true (null is not true)."""
    return F.count_if(p)


# Below it every double is a whole number of bigint plus a fraction.
_WHOLE = float(1 << 53)
_DIGITS, _HALF, _UPPER = 15, 10**8, 10**7


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def total(c: Column, data_type: T.DataType) -> Column:
    """Sum as a double, whatever the order in which partitions are combined: values below
    1e28 are summed exactly, as decimals of 15 digits (all that a double holds of any
    decimal), or whole numbers, and the sum is rounded once.

    Whole part and fraction of a binary float are summed as bigint halves of at most
    eight digits, which stay compiled and hold 10^10 rows; from 2^53 on as decimals.
    Larger values, infinities and NaN are added as doubles. Other types are summed as
    they are.
    """
    if not isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.sum(c).cast("double")
    c = c.cast("double")
    small, exact = F.abs(c) < _WHOLE, F.abs(c) < 1e28
    near = F.when(small, c)
    whole = F.floor(near)
    # The fraction has the digits that the whole part leaves, in units of 1e-15.
    taken = F.when(F.abs(whole) >= 1, F.floor(F.log10(F.abs(whole).cast("double"))) + 1).otherwise(F.lit(0))
    taken = F.least(taken, F.lit(_DIGITS)).cast("int")
    scale = F.get(F.array(*[F.lit(10.0 ** (_DIGITS - i)) for i in range(_DIGITS + 1)]), taken)
    unit = F.get(F.array(*[F.lit(10**i).cast("bigint") for i in range(_DIGITS + 1)]), taken)
    part = F.rint((near - whole) * scale).cast("bigint") * unit

    def added(v: Column) -> Column:
        return F.coalesce(F.sum(v), F.lit(0).cast("bigint"))

    low = added(part % _HALF)
    high = added(_div(part, _HALF)) + _div(low, _HALF)
    units = (high % _UPPER) * _HALF + low % _HALF
    fraction = units.cast("decimal(15,0)") * F.lit("0.000000000000001").cast("decimal(15,15)")
    wholes = added(_div(whole, _HALF)).cast("decimal(20,0)") * F.lit(_HALF).cast("decimal(9,0)")
    wholes = wholes + (added(whole % _HALF) + _div(high, _UPPER)).cast("decimal(20,0)")
    far = F.sum(F.when(~small & exact, c).cast("decimal(38,0)"))
    wholes = wholes.cast("decimal(38,0)") + F.coalesce(far, F.lit(0).cast("decimal(38,0)"))
    # Below 1e17 both fit one decimal: a single rounding to double.
    narrow = (wholes.try_cast("decimal(18,0)") + fraction).cast("double")
    joined = F.when(F.count_if(exact) > 0, F.coalesce(narrow, wholes.cast("double")))
    rest = F.sum(F.when(~exact, c))
    return F.when(rest.isNull(), joined).otherwise(rest + F.coalesce(joined, F.lit(0.0)))


def number_sum(df: DataFrame, column: str) -> Column:
    """SUM of a column: of floats as `total`, of other numbers in their own type."""
    kind = type_of(df, column)
    return total(F.expr(column), kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.sum(F.expr(column))


def exact_avg(df: DataFrame, column: str) -> Column:
    return total(F.expr(column), type_of(df, column)) / F.count(F.expr(column))


def aggregate_column(df: DataFrame, fn: str, column: str) -> Column:
    if fn == "count":
        return rows() if column in ("*", "1") else F.count(F.expr(column))
    if fn == "count_distinct":
        return F.count_distinct(F.expr(column))
    if fn == "sum":
        return total(F.expr(column), type_of(df, column))
    if fn == "avg":
        return exact_avg(df, column)
    if fn in ("min", "max"):
        return getattr(F, fn)(F.expr(column))
    raise ValueError(f"aggregate must be one of {AGGREGATES}, not {fn!r}")


def ir_aggregate(
    df: DataFrame,
    aggregations: Mapping[str, tuple[str, str]],
    partition_by: Sequence[str] = (),
    own_types: bool = False,
) -> DataFrame:
    """`{"revenue": ("sum", "price * qty")}` per group, or overall. Sums are doubles;
    with `own_types` those of whole numbers and decimals stay exact."""

    def column(fn: str, c: str) -> Column:
        return number_sum(df, c) if own_types and fn == "sum" else aggregate_column(df, fn, c)

    cols = [column(fn, c).alias(name) for name, (fn, c) in aggregations.items()]
    return df.groupBy(*partition_by).agg(*cols) if partition_by else df.agg(*cols)
