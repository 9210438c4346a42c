"""Joins between a table and the keys of another.

Keys are reduced to one row per key BEFORE they are joined. The reduction
combines on the map side, so a key that holds a third of all rows travels as one
row per map task, and the join re-uses the partitioning the reduction produced.
Where whole rows have to be joined, adaptive skew handling splits the hot
partition (left side of a left, semi or anti join). No broadcast is forced: Spark
broadcasts a side only when its measured size is below the session's threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .intervals import BUCKET_ROWS, HOT_ROWS, with_bucket

JOIN_TYPES = ("inner", "left", "right", "full")


def all_present(columns: Sequence[str]) -> Column:
    cond = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        cond = cond & F.col(c).isNotNull()
    return cond


def broadcastable(df: DataFrame) -> bool:
    """Whether Spark itself would broadcast this table: its estimated size, from
    file sizes and statistics, against the session's threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 < limit and int(size) <= limit


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per complete key: columns k0.., n."""
    return (
        df.filter(all_present(columns))
        .groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_keys(df: DataFrame, columns: Sequence[str], prefix: str = "r") -> DataFrame:
    return (
        df.filter(all_present(columns))
        .select(*[F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(columns)])
        .distinct()
    )


def on_keys(n: int, left: str = "k", right: str = "r") -> Column:
    cond = F.col(f"{left}0") == F.col(f"{right}0")
    for i in range(1, n):
        cond = cond & (F.col(f"{left}{i}") == F.col(f"{right}{i}"))
    return cond


def orphan_keys(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, ref_columns: Sequence[str]
) -> DataFrame:
    """Child keys without a parent and how many child rows carry each."""
    return key_counts(child, columns).join(
        distinct_keys(parent, ref_columns), on_keys(len(columns)), "left_anti"
    )


def _match(df: DataFrame, columns: Sequence[str]) -> Column:
    cond = df[columns[0]] == F.col("r0")
    for i, c in enumerate(columns[1:], start=1):
        cond = cond & (df[c] == F.col(f"r{i}"))
    return cond


def orphan_rows(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, ref_columns: Sequence[str]
) -> DataFrame:
    """Child rows whose complete key has no parent."""
    present = child.filter(all_present(columns))
    return present.join(distinct_keys(parent, ref_columns), _match(present, columns), "left_anti")


def covered_rows(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, ref_columns: Sequence[str]
) -> DataFrame:
    """Child rows whose key has a parent."""
    return child.join(distinct_keys(parent, ref_columns), _match(child, columns), "left_semi")


def _column_of(key: str) -> str:
    return key.rsplit(".", 1)[-1]


def ir_join(
    df: DataFrame, other: DataFrame, left: str, right: str, how: str = "left"
) -> DataFrame:
    """Join on keys written TABLE.COL; left join unless told otherwise."""
    if how not in JOIN_TYPES:
        raise ValueError(f"join type must be one of {JOIN_TYPES}, not {how!r}")
    cond = df[_column_of(left)] == other[_column_of(right)]
    return df.join(other, cond, "full_outer" if how == "full" else how)


# Copies of a row are written out in steps, so that no array grows with their number.
COPIES = 10_000


def _copies(df: DataFrame, n: str, first: Column, out: str) -> DataFrame:
    """Every row `n` times, numbered from `first`."""
    whole = df.filter(F.col(n) > 0)
    whole = whole.withColumn("_step", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / COPIES))))
    left = F.least(F.lit(COPIES), F.col(n) - F.col("_step") * COPIES)
    whole = whole.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), left - 1)))
    return whole.withColumn(out, first + F.col("_step") * COPIES + F.col("_i")).drop("_step", "_i")


def key_compare(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Two tables side by side, every row of either in exactly one row of the result.

    `side` is left, right, same or differs; values come as `<col>_left` and
    `<col>_right`. Null keys match each other, null values are equal. Where a key
    repeats, equal rows are matched first, one with one; what is left of both sides
    is paired by rank in an order by hash, and the rest of the longer side stands
    alone. Rows are first reduced to a count per key and values; keys with more than
    `hot_rows` unmatched values are ranked in buckets.
    """

    def one_side(df: DataFrame, sign: str) -> DataFrame:
        kept = df.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.struct(F.lit(0).alias("_"), *values).alias("_row"),
        )
        return kept.withColumns({"_l": F.lit(int(sign == "l")), "_r": F.lit(int(sign == "r"))})

    names = [f"_k{i}" for i in range(len(keys))]
    both = one_side(left, "l").unionByName(one_side(right, "r"))
    counted = both.groupBy(*names, "_row").agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    # One count per key and values, once as equal rows and once as what is left over.
    equal = F.least("_l", "_r")
    parts = F.array(
        F.struct(F.lit("same").alias("side"), equal.alias("n")),
        F.struct(F.lit("left").alias("side"), (F.col("_l") - equal).alias("n")),
        F.struct(F.lit("right").alias("side"), (F.col("_r") - equal).alias("n")),
    )
    parts = counted.select(*names, "_row", F.inline(F.filter(parts, lambda p: p["n"] > 0)))
    same = _copies(parts.filter("side = 'same'"), "n", F.lit(0), "_rank")
    same = same.select(*names, "side", F.col("_row").alias("_a"), F.col("_row").alias("_b"))

    rest = parts.filter("side != 'same'").withColumns(
        {"_p": F.xxhash64("_row"), "_t": F.hash("_row").cast("bigint")}
    )
    bucketed = with_bucket(rest, names, "_p", "_t", hot_rows, bucket_rows)
    sums = bucketed.groupBy(*names, "side", "_bucket").agg(F.sum("n").alias("_n"))
    earlier = W.partitionBy(*names, "side").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select(
        *[F.col(k).alias(f"_h{k}") for k in names],
        F.col("side").alias("_hside"),
        F.col("_bucket").alias("_hbucket"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"),
    ).filter("_ahead > 0")
    on = (F.col("side") == F.col("_hside")) & (F.col("_bucket") == F.col("_hbucket"))
    for k in names:
        on = on & F.col(k).eqNullSafe(F.col(f"_h{k}"))
    inside = W.partitionBy(*names, "side", "_bucket").orderBy("_p", "_t", "_row")
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    begun = bucketed.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ahead, on, "left")
    first = F.coalesce("_ahead", F.lit(0)) + F.col("_before")
    ranked = _copies(begun, "n", first, "_rank")
    paired = ranked.groupBy(*names, "_rank").agg(
        *[F.max(F.when(F.col("side") == s, F.col("_row"))).alias(n) for s, n in (("left", "_a"), ("right", "_b"))]
    )
    alone = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("differs")
    out = same.unionByName(paired.select(*names, alone.alias("side"), "_a", "_b"))
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        "side",
        *[F.col(s)[v].alias(f"{v}_{o}") for v in values for s, o in (("_a", "left"), ("_b", "right"))],
    )
