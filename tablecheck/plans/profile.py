"""Column profiles in one pass over a table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.aggregates import rows, total
from ..operators.distinct import distinct_counts
from ..sources.local import local_frame

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FLOATS = (T.FloatType, T.DoubleType)
_UNORDERED = (T.MapType, T.VariantType)


def _text(c: Column, t: T.DataType) -> Column:
    """Numbers in plain notation with all their places, as far as 38 digits hold them."""
    if not isinstance(t, _FLOATS):
        return c.cast("string")
    plain = c.cast("string").try_cast("decimal(38,18)").cast("string")
    return F.coalesce(F.regexp_replace(plain, r"\.?0+$", ""), c.cast("string"))


def profile(
    df: DataFrame,
    dataset: str = "-",
    columns: Sequence[str] | None = None,
    exact_distinct: bool | Sequence[str] = False,
    rsd: float = 0.02,
) -> DataFrame:
    """dataset, column, type, row_count, null_count, null_rate, distinct_count,
    min, max, avg, stddev: one aggregate over all columns.

    Distinct counts are sketches (a few KB per column, merged like any partial
    aggregate) unless asked for exactly, for all or for named columns. The exact
    ones are one more pass over the named columns, reduced to distinct (column,
    value) pairs inside each task.
    """
    names = list(columns or df.columns)
    exact_for = set(names if exact_distinct is True else (exact_distinct or ()))
    none = F.lit(None)
    aggs, lines = [rows().alias("n")], []
    wanted = [n for n in names if n in exact_for and not isinstance(df.schema[n].dataType, _UNORDERED)]
    counted = distinct_counts(df, {n: F.col(n) for n in wanted}).scalar() if wanted else none
    for i, name in enumerate(names):
        t = df.schema[name].dataType
        c = F.col(name)
        numeric, ordered = isinstance(t, _NUMERIC), not isinstance(t, _UNORDERED)
        aggs.append(F.count(c).alias(f"p{i}_count"))
        distinct: Column = none
        if ordered and name in exact_for:
            distinct = F.coalesce(F.element_at(F.col("_counts"), name), F.lit(0))
        elif ordered:
            aggs.append(F.approx_count_distinct(c, rsd).alias(f"p{i}_distinct"))
            distinct = F.col(f"p{i}_distinct")
        simple = ordered and not isinstance(t, (T.ArrayType, T.StructType))
        if simple:
            aggs += [F.min(c).alias(f"p{i}_min"), F.max(c).alias(f"p{i}_max")]
        if numeric:
            aggs += [total(c, t).alias(f"p{i}_sum"), F.stddev(c).alias(f"p{i}_dev")]
        count = F.col(f"p{i}_count")
        lines.append(
            F.struct(
                F.lit(dataset).alias("dataset"),
                F.lit(name).alias("column"),
                F.lit(t.simpleString()).alias("type"),
                F.col("n").alias("row_count"),
                (F.col("n") - count).alias("null_count"),
                F.when(F.col("n") > 0, (F.col("n") - count) / F.col("n")).cast("double").alias("null_rate"),
                distinct.cast("bigint").alias("distinct_count"),
                (_text(F.col(f"p{i}_min"), t) if simple else none.cast("string")).alias("min"),
                (_text(F.col(f"p{i}_max"), t) if simple else none.cast("string")).alias("max"),
                (
                    F.when(count > 0, F.col(f"p{i}_sum") / count)
                    if numeric
                    else none.cast("double")
                ).alias("avg"),
                (F.col(f"p{i}_dev") if numeric else none.cast("double")).alias("stddev"),
            )
        )
    measured = df.agg(*aggs)
    if wanted:
        measured = measured.withColumn("_counts", counted)
    return measured.select(F.inline(F.array(*lines)))


def last_updated(df: DataFrame, watermark: str) -> DataFrame:
    return df.agg(F.max(watermark).alias("last_updated"), rows().alias("row_count"))


def table_stats(df: DataFrame) -> DataFrame:
    return df.agg(rows().alias("row_count"))


def propose_keys(df: DataFrame, dataset: str = "-", candidates: Sequence[str] | None = None) -> DataFrame:
    """Single columns that could be a key: no nulls and as many values as rows.

    Columns with a null are left out by a count of nulls, one narrow pass; all others
    are counted exactly, whatever a sketch would say of them.
    """
    names = [c for c in candidates or df.columns if not isinstance(df.schema[c].dataType, _UNORDERED)]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first() if names else ()
    full = [c for c, n in zip(names, nulls) if not n]
    if not full:
        return local_frame(df.sparkSession, [], "dataset string, column string, row_count bigint, distinct_count bigint")
    counted = profile(df, dataset, full, exact_distinct=True)
    return counted.filter(F.col("distinct_count") == F.col("row_count")).select(
        "dataset", "column", "row_count", "distinct_count"
    )


PROFILE_SCHEMA = (
    "dataset string, column string, type string, row_count bigint, null_count bigint, "
    "null_rate double, distinct_count bigint, min string, max string, avg double, stddev double"
)


def profile_of(value: Any) -> DataFrame:
    return value if "null_rate" in value.columns else profile(value)
