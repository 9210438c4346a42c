"""Row differences between two snapshots of a table.

Two phases. First both snapshots are netted by key and a 128-bit hash of the row: +1
for current, -1 for previous. Equal rows cancel on the map side as far as they meet
there and completely in one narrow shuffle; no other column travels. Then the rows of
the hashes that remain are fetched: a bitmap of bounded size drops nearly all others
while they are scanned, before any join. No row is paired with another, so copies of a
key cannot multiply. To tell which columns of a key changed, tables with few columns
take a hash of each along in the first phase and need no second one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import names_where
from ..verdict import Judgement, Measurement, result, zero
from .rowhash import HASH, comparable, fetched, with_row_hash

# With more columns besides the keys the rows themselves are fetched instead of a hash
# of every column being shuffled for all rows. At most 63: one bit each.
HASHED_COLUMNS = 16
_FIXED = (
    T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType
)


def aligned(cur: DataFrame, prev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the columns of `cur` in the types that hold the values of both."""
    prev = prev.select(*cur.columns)
    wide = cur.limit(0).unionByName(prev.limit(0)).schema
    if wide == cur.schema == prev.schema:
        return cur, prev
    casts = [F.col(f.name).cast(f.dataType).alias(f.name) for f in wide]
    return cur.select(*casts), prev.select(*casts)


def net_hashes(
    cur: DataFrame, prev: DataFrame, keys: Sequence[str] = (), taken: Sequence[Column] = ()
) -> DataFrame:
    """keys ..., hash and `_net` of differing rows: copies more (+) or fewer (-). `taken`
    are numbers that equal rows have in common and that come along."""
    signed = [
        with_row_hash(df, cur.columns).select(*keys, *HASH, F.lit(sign).alias("_one"), *taken)
        for df, sign in ((cur, 1), (prev, -1))
    ]
    along = [F.max(c).alias(c) for c in signed[0].columns[len(keys) + len(HASH) + 1 :]]
    netted = signed[0].unionByName(signed[1]).groupBy(*keys, *HASH).agg(F.sum("_one").alias("_net"), *along)
    return netted.filter(F.col("_net") != 0)


def except_both(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Multiset difference in both directions: `side` and number of `copies`."""
    cur, prev = aligned(cur, prev)
    columns = cur.columns
    net = net_hashes(cur, prev)
    rows = fetched(cur, columns, net.filter("_net > 0")).unionByName(fetched(prev, columns, net.filter("_net < 0")))
    single = rows.groupBy(*HASH, "_net").agg(F.first(F.struct(*columns)).alias("_row"))
    return single.select(
        F.when(F.col("_net") > 0, "current_only").otherwise("previous_only").alias("side"),
        F.abs("_net").alias("copies"),
        *[F.col("_row").getField(c).alias(c) for c in columns],
    )


def key_changes(
    cur: DataFrame, prev: DataFrame, keys: Sequence[str], hashed_columns: int = HASHED_COLUMNS
) -> DataFrame:
    """Per differing key: rows added, removed and changed, and for keys that are
    unique on both sides which columns changed."""
    cur, prev = aligned(cur, prev)
    values = [c for c in cur.columns if c not in keys]
    changes = _changes_by_hash if len(values) <= hashed_columns else _changes_by_row
    return changes(cur, prev, keys, values)


def _change_counts(net: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    return net.groupBy(*keys).agg(
        F.sum(F.when(F.col("_net") > 0, F.col("_net")).otherwise(0)).alias("_plus"),
        F.sum(F.when(F.col("_net") < 0, -F.col("_net")).otherwise(0)).alias("_minus"),
        *more,
    )


_SINGLE = "_plus = 1 AND _minus = 1"


def _change_lines(counts: DataFrame, keys: Sequence[str], differ: Sequence[tuple[str, Column]]) -> DataFrame:
    changed, single = F.least("_plus", "_minus"), F.expr(_SINGLE)
    return counts.select(
        *keys,
        (F.col("_plus") - changed).alias("added"),
        (F.col("_minus") - changed).alias("removed"),
        changed.alias("changed"),
        names_where((name, single & c) for name, c in differ).alias("changed_columns"),
    )


def column_hashes(df: DataFrame, columns: Sequence[str]) -> list[list[Column]]:
    """Per column the hashes that stand for its values: 64 bits where a value has no more,
    which name it exactly, else 128."""
    out = []
    for name in columns:
        kind = df.schema[name].dataType
        value = comparable(F.col(name), kind)
        out.append([F.xxhash64(value)] if isinstance(kind, _FIXED) else [F.xxhash64(value), F.xxhash64(F.lit("second"), value)])
    return out


def _changes_by_hash(cur: DataFrame, prev: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One phase: every row travels as its key and its hashes. Of a key with one row left
    on each side, hashes that differ leave a rest when they are combined by exclusive or."""
    hashes = column_hashes(cur, values)
    names = [[f"_x{i}_{j}" for j in range(len(h))] for i, h in enumerate(hashes)]
    flat = [n for each in names for n in each]
    nulls = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(F.col(v).isNull(), F.lit(1 << i).cast("bigint")).otherwise(0) for i, v in enumerate(values)],
        F.lit(0).cast("bigint"),
    )
    taken = [c.alias(n) for each, h in zip(names, hashes) for n, c in zip(each, h)]
    net = net_hashes(cur, prev, keys, [*taken, nulls.alias("_nulls")])
    counts = _change_counts(net, keys, *[F.bit_xor(n).alias(n) for n in [*flat, "_nulls"]])
    differ = [
        (
            v,
            reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names[i]])
            | (F.col("_nulls").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0),
        )
        for i, v in enumerate(values)
    ]
    return _change_lines(counts, keys, differ)


def _changes_by_row(cur: DataFrame, prev: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two phases: the rows of keys with one row left on each side are fetched and compared."""
    columns = cur.columns
    net = net_hashes(cur, prev, keys)
    counts = _change_counts(net, keys)
    names = [f"_k_{k}" for k in keys]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    ones = counts.filter(_SINGLE).select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    pairs = net.join(ones, same, "left_semi")
    sides = [fetched(df, columns, pairs.filter(side)) for df, side in ((cur, "_net > 0"), (prev, "_net < 0"))]

    def taken(side: str) -> Column:
        row = F.struct(*[comparable(F.col(v), cur.schema[v].dataType).alias(f"v{i}") for i, v in enumerate(values)])
        return F.first(F.when(F.expr(side), row), ignorenulls=True)

    found = sides[0].unionByName(sides[1]).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    found = found.agg(taken("_net > 0").alias("_c"), taken("_net < 0").alias("_p"))
    differ = [(v, ~F.col("_c")[f"v{i}"].eqNullSafe(F.col("_p")[f"v{i}"])) for i, v in enumerate(values)]
    return _change_lines(counts.join(found, same, "left"), keys, differ)


def compare_measurement(cur: DataFrame, prev: DataFrame, keys: Sequence[str]) -> Measurement:
    values = [c for c in cur.columns if c not in keys]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))

    def judge(m: Any) -> Judgement:
        bad = m("added") + m("removed") + m("changed")
        return Judgement(
            violations=bad,
            passed=zero(bad),
            observed=bad,
            expected=F.lit(0),
            metrics={
                "added": m("added"),
                "removed": m("removed"),
                "changed": m("changed"),
                **{f"changed.{v}": m(f"col_{v}") for v in values},
            },
        )

    return Measurement(
        key_changes(cur, prev, keys),
        {
            "added": total("added"),
            "removed": total("removed"),
            "changed": total("changed"),
            **{f"col_{v}": F.count_if(F.array_contains("changed_columns", v)) for v in values},
        },
        judge,
    )


def compare_snapshots(
    cur: DataFrame, prev: DataFrame, keys: Sequence[str], **label: Any
) -> DataFrame:
    return result("drift", compare_measurement(cur, prev, keys), **label)


def failure_profile(rows: DataFrame, dims: Sequence[str], k: int = 10) -> DataFrame:
    """Where violating rows cluster: the k most frequent values per dimension.

    Counted per (dimension, value) before ranking; Spark limits each map task to
    k candidates per dimension before the ranking shuffle.
    """
    from pyspark.sql import Window as W

    long = rows.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                    for d in dims
                ]
            )
        )
    )
    counts = long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("violations"))
    rank = F.row_number().over(
        W.partitionBy("dimension").orderBy(F.desc("violations"), F.asc_nulls_first("value"))
    )
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)
