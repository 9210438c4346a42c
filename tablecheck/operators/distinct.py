"""Exact distinct counts of many columns at once.

Several COUNT(DISTINCT) in one aggregate make Spark repeat every row per column
through the whole aggregation. Here rows are turned into (column, value) pairs that
are reduced to distinct ones inside each task, so that a column of few values sends a
few rows per task, and long values send 128 bits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

_SHORT = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_FLOATS = (T.FloatType, T.DoubleType)
LONG_VALUE = 32  # bytes; longer values are named by a hash


def value_key(c: Column, data_type: T.DataType) -> Column:
    """Binary that is equal for equal values of a column only; null for null. -0.0 is 0.0
    and NaN is NaN."""
    if isinstance(data_type, _FLOATS):
        return (c + F.lit(0.0).cast(data_type)).cast("string").cast("binary")
    if isinstance(data_type, _SHORT):
        return c.cast("string").cast("binary")
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        raw = c.cast("binary")
    else:
        raw = F.when(c.isNotNull(), F.to_json(F.struct(c))).cast("binary")
    # A hash of 16 bytes after a mark and 16 more: longer than any value kept whole.
    long = F.concat(F.lit(b"\0" * (LONG_VALUE - 15)), F.unhex(F.substring(F.sha2(raw, 256), 1, 32)))
    return F.when(F.octet_length(raw) <= LONG_VALUE, raw).otherwise(long)


def distinct_counts(df: DataFrame, columns: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by ..., counts): a map from the names of `columns` to how many different values
    they hold, nulls not counted. A name without values is not in the map."""
    names = list(columns)
    types = [f.dataType for f in df.select(*columns.values()).schema]
    pairs = [
        F.struct(F.lit(i).alias("_i"), value_key(c, t).alias("_v"))
        for i, (c, t) in enumerate(zip(columns.values(), types))
    ]
    long = df.select(*by, F.inline(F.array(*pairs))).filter(F.col("_v").isNotNull())
    single = long.groupBy(*by, "_i", "_v").agg(F.lit(1).alias("_one"))
    counts = single.groupBy(*by, "_i").agg(F.count("_one").alias("_n"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    entries = F.collect_list(F.struct(name.alias("name"), F.col("_n").alias("n")))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias("counts"))
