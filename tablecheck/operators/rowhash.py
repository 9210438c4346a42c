"""Rows by 128-bit hashes: what they hold in common is found without their columns.

A hash names the values of some columns; groups and differences of rows are found on
hashes alone, and only the rows in question are then looked at whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

HASH = ("_h1", "_h2")
# Bitmaps of 4 KB, at most so many: 256 KB.
BITMAPS, BITS = 64, 32768
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType)


def canonical(c: Column, t: T.DataType) -> Column:
    """A value of which equal ones have one form: entries of maps ordered by key, -0.0
    as 0.0, variants as text."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return c + F.lit(0.0).cast(t)
    if isinstance(t, T.VariantType):
        return F.to_json(F.struct(c.alias("v")))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, t.elementType))
    if isinstance(t, T.StructType):
        fields = [canonical(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(t, T.MapType):
        pairs = F.array_sort(F.map_keys(c))
        return F.transform(pairs, lambda k: F.struct(k.alias("k"), canonical(F.element_at(c, k), t.valueType).alias("v")))
    return c


def comparable(c: Column, t: T.DataType) -> Column:
    """A column that is equal, null-safely, for equal values of any type."""
    if not isinstance(t, _NESTED):
        return canonical(c, t)
    text = F.to_json(F.struct(canonical(c, t).alias("v")), {"ignoreNullFields": "false"})
    return F.when(c.isNotNull(), text)


def with_row_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds 128 bits that stand for the values of `columns`, as two numbers. A null
    counts by its place."""
    parts: list[Column] = []
    for name in columns:
        parts += [F.col(name).isNull(), comparable(F.col(name), df.schema[name].dataType)]
    return df.withColumns({HASH[0]: F.xxhash64(*parts), HASH[1]: F.xxhash64(F.lit("second"), *reversed(parts))})


def marked(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `df`, with hash, whose hash may be in `wanted`, and all whose is.

    One bit per wanted hash, in bitmaps that are a scalar of the scan: no row is shuffled
    to find out. With far more hashes than bits all rows pass."""
    place = F.pmod(F.col(HASH[0]), F.lit(BITMAPS * BITS))
    bitmap, bit = F.floor(place / BITS).cast("int"), F.pmod(place, F.lit(BITS))
    bits = wanted.groupBy(bitmap.alias("i")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    known = bits.agg(F.map_from_entries(F.collect_list(F.struct("i", "bits")))).scalar()
    byte = F.substring(F.element_at(known, bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    told = F.call_function("bit_get", F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(bit, F.lit(8)).cast("int"))
    return df.filter(F.coalesce(told == 1, F.lit(False)))


def fetched(df: DataFrame, columns: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The rows of `df` whose hash is in `wanted` (hash, _net), with `_net`."""
    rows = marked(with_row_hash(df.select(*columns), columns), wanted)
    return rows.join(wanted.select(*HASH, "_net"), list(HASH))
