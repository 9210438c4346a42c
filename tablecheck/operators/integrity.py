"""Keys, nulls, references, allowed values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.predicates import names_where
from ..verdict import Judgement, Measurement, result, zero
from . import joins
from .aggregates import count_if, rows
from .rowhash import HASH, comparable, marked, with_row_hash

# ---------------------------------------------------------------- uniqueness


_WIDE = (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType, T.VariantType)


def wide(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether keys can be long: such rows are reduced by a hash of the keys first."""
    return any(isinstance(df.schema[k].dataType, _WIDE) for k in keys)


def suspects(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`columns` of the rows whose keys' hash occurs more than once, and of few others."""
    hashed = with_row_hash(df, keys)
    repeated = hashed.groupBy(*HASH).agg(rows().alias("_n")).filter(F.col("_n") > 1)
    return marked(hashed, repeated).select(*columns)


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row count. Long keys are shuffled
    only where their hash says that they may be duplicates."""
    rows_in = suspects(df, keys, keys) if wide(df, keys) else df
    counted = rows_in.groupBy(*keys).agg(rows().alias("duplicate_count"))
    return counted.filter(F.col("duplicate_count") > 1)


def top_duplicates(df: DataFrame, keys: Sequence[str], limit: int = 100) -> DataFrame:
    return duplicate_groups(df, keys).orderBy(F.desc("duplicate_count"), *keys).limit(limit)


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of the duplicated groups."""
    dups = duplicate_groups(df, keys).select(*[F.col(k).alias(f"_d_{k}") for k in keys])
    rows_in = suspects(df, keys, df.columns) if wide(df, keys) else df
    cond = reduce(lambda a, b: a & b, [rows_in[k].eqNullSafe(F.col(f"_d_{k}")) for k in keys])
    return rows_in.join(dups, cond, "left_semi")


def key_group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of the groups of equal keys: `_n`, and `_rows`, how many rows a line stands
    for. Groups of one row may share a line.

    Long keys are reduced to 128 bits; what collides there is grouped by the keys
    themselves, in the form that `comparable` gives them, so maps and variants are keys
    too."""
    if not wide(df, keys):
        groups = df.groupBy(*keys).agg(rows().alias("_n"))
        return groups.select("_n", F.col("_n").alias("_rows"))
    by_hash = with_row_hash(df, keys).groupBy(*HASH).agg(rows().alias("_n"))
    single = by_hash.filter(F.col("_n") == 1).agg(F.lit(1).cast("bigint").alias("_n"), rows().alias("_rows"))
    whole = [comparable(F.col(k), df.schema[k].dataType).alias(f"_k{i}") for i, k in enumerate(keys)]
    hashed = with_row_hash(df, keys).select(*HASH, *whole)
    repeated = by_hash.filter(F.col("_n") > 1)
    again = marked(hashed, repeated).join(repeated.select(*HASH), list(HASH), "left_semi")
    exact = again.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(rows().alias("_n"))
    return single.unionByName(exact.select("_n", F.col("_n").alias("_rows")))


def unique_measurement(df: DataFrame, keys: Sequence[str], dup_rows: int = 0) -> Measurement:
    if not keys:
        raise ValueError("a uniqueness check needs keys")
    dup = F.col("_n") > 1
    return Measurement(
        key_group_sizes(df, keys),
        {
            "groups": count_if(dup),
            "rows": F.coalesce(F.sum(F.when(dup, F.col("_n"))), F.lit(0)),
            "total": F.coalesce(F.sum("_rows"), F.lit(0)),
        },
        lambda m: Judgement(
            violations=m("groups"),
            passed=m("groups") <= dup_rows,
            observed=m("groups"),
            expected=F.lit(0),
            tolerance=F.lit(dup_rows),
            metrics={
                "duplicate_groups": m("groups"),
                "total_duplicates": m("rows"),
                "total_rows": m("total"),
            },
        ),
    )


def check_unique(df: DataFrame, keys: Sequence[str], dup_rows: int = 0, **label: Any) -> DataFrame:
    return result("uniqueness", unique_measurement(df, keys, dup_rows), **label)


# --------------------------------------------------------------------- nulls


def any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def null_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.filter(any_null(keys))


def not_null_measurement(df: DataFrame, keys: Sequence[str]) -> Measurement:
    if not keys:
        raise ValueError("a not-null check needs keys")
    per_key = {f"null_{k}": count_if(F.col(k).isNull()) for k in keys}
    return Measurement(
        df,
        {"nulls": count_if(any_null(keys)), "total": rows(), **per_key},
        lambda m: Judgement(
            violations=m("nulls"),
            passed=zero(m("nulls")),
            observed=m("nulls"),
            expected=F.lit(0),
            metrics={
                "null_count": m("nulls"),
                "total_rows": m("total"),
                **{f"null_count.{k}": m(f"null_{k}") for k in keys},
            },
        ),
    )


def check_not_null(df: DataFrame, keys: Sequence[str], **label: Any) -> DataFrame:
    return result("not_null", not_null_measurement(df, keys), **label)


def blank(key: str) -> Column:
    c = F.col(key).cast("string")
    return c.isNull() | (F.trim(c) == "")


def blank_rows(df: DataFrame, business_keys: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [blank(k) for k in business_keys]))


def dim_complete_measurement(df: DataFrame, business_keys: Sequence[str]) -> Measurement:
    bad = reduce(lambda a, b: a | b, [blank(k) for k in business_keys])
    return Measurement(
        df,
        {
            "bad": count_if(bad),
            "total": rows(),
            **{f"blank_{k}": count_if(blank(k)) for k in business_keys},
        },
        lambda m: Judgement(
            violations=m("bad"),
            passed=zero(m("bad")),
            observed=m("bad"),
            expected=F.lit(0),
            metrics={
                "incomplete_rows": m("bad"),
                "total_rows": m("total"),
                **{f"incomplete.{k}": m(f"blank_{k}") for k in business_keys},
            },
        ),
    )


def check_dim_complete(df: DataFrame, business_keys: Sequence[str], **label: Any) -> DataFrame:
    return result("dim_complete", dim_complete_measurement(df, business_keys), **label)


# ---------------------------------------------------------------- references


def foreign_key_measurement(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, ref_columns: Sequence[str]
) -> Measurement:
    return Measurement(
        joins.orphan_keys(child, columns, parent, ref_columns),
        {"keys": rows(), "rows": F.coalesce(F.sum("n"), F.lit(0))},
        lambda m: Judgement(
            violations=m("rows"),
            passed=zero(m("rows")),
            observed=m("rows"),
            expected=F.lit(0),
            metrics={"orphan_rows": m("rows"), "orphan_keys": m("keys")},
        ),
    )


def check_foreign_key(
    child: DataFrame,
    columns: Sequence[str],
    parent: DataFrame,
    ref_columns: Sequence[str],
    **label: Any,
) -> DataFrame:
    return result(
        "foreign_key", foreign_key_measurement(child, columns, parent, ref_columns), **label
    )


Dimension = tuple[Sequence[str], DataFrame, Sequence[str]]


def coverage_frame(fact: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Fact rows as counted combinations: `n` and a flag `hit<i>` per dimension.

    Dimensions below the broadcast threshold come first and cost no shuffle. For
    every other one the fact is first reduced to the keys still needed and the
    flags found so far: copies of a hot key collapse on the map side, before the
    join, and each join leaves one key less.
    """
    small = [i for i, d in enumerate(dims) if joins.broadcastable(d[1])]
    large = [i for i in range(len(dims)) if i not in small]
    columns = list(dict.fromkeys(c for cols, _, _ in dims for c in cols))
    frame = fact.select(*columns, F.lit(1).cast("bigint").alias("n"))
    for i in small:
        frame = _flag(frame, dims[i], i)
    hits = [f"hit{i}" for i in small]
    for at, i in enumerate(large):
        needed = list(dict.fromkeys(c for k in large[at:] for c in dims[k][0]))
        frame = frame.groupBy(*needed, *hits).agg(F.sum("n").alias("n"))
        frame = _flag(frame, dims[i], i)
        hits.append(f"hit{i}")
    return frame.select("n", *hits)


def _flag(frame: DataFrame, dim: Dimension, i: int) -> DataFrame:
    cols, table, ref = dim
    keys = distinct_keys_flagged(table, ref, i)
    cond = reduce(lambda a, b: a & b, [frame[c] == keys[f"d{i}_{j}"] for j, c in enumerate(cols)])
    return frame.join(keys, cond, "left").drop(*[f"d{i}_{j}" for j in range(len(cols))])


def distinct_keys_flagged(dim: DataFrame, ref: Sequence[str], i: int) -> DataFrame:
    keys = joins.distinct_keys(dim, ref, prefix=f"d{i}_")
    return keys.withColumn(f"hit{i}", F.lit(True))


def fact_coverage_measurement(
    fact: DataFrame, dims: Sequence[Dimension], min_rate: float = 1.0
) -> Measurement:
    frame = coverage_frame(fact, dims)
    hits = [F.coalesce(F.col(f"hit{i}"), F.lit(False)) for i in range(len(dims))]
    covered = reduce(lambda a, b: a & b, hits)

    def weight(p: Column) -> Column:
        return F.coalesce(F.sum(F.when(p, F.col("n"))), F.lit(0))

    def judge(m: Any) -> Judgement:
        missing = m("total") - m("covered")
        rate = F.when(m("total") > 0, m("covered") / m("total")).otherwise(1.0)
        return Judgement(
            violations=missing,
            passed=rate >= min_rate,
            observed=rate,
            expected=F.lit(min_rate),
            metrics={
                "total_rows": m("total"),
                "covered_rows": m("covered"),
                "coverage": rate,
                **{f"missing.{','.join(d[0])}": m(f"miss{i}") for i, d in enumerate(dims)},
            },
        )

    return Measurement(
        frame,
        {
            "total": F.coalesce(F.sum("n"), F.lit(0)),
            "covered": weight(covered),
            **{f"miss{i}": weight(~h) for i, h in enumerate(hits)},
        },
        judge,
    )


def uncovered_rows(fact: DataFrame, dims: Sequence[Dimension]) -> DataFrame:
    """Fact rows that a dimension lacks, with `missing`, the columns of those dimensions."""
    frame = fact
    for i, dim in enumerate(dims):
        frame = _flag(frame, dim, i)
    lacks = [(",".join(d[0]), F.col(f"hit{i}").isNull()) for i, d in enumerate(dims)]
    out = frame.filter(reduce(lambda a, b: a | b, [lack for _, lack in lacks], F.lit(False)))
    return out.select(*fact.columns, names_where(lacks).alias("missing"))


def check_fact_coverage(
    fact: DataFrame, dims: Sequence[Dimension], min_rate: float = 1.0, **label: Any
) -> DataFrame:
    return result("fact_coverage", fact_coverage_measurement(fact, dims, min_rate), **label)


# -------------------------------------------------------- values, invariants


def _simple(df: DataFrame, kind: str, bad: Column, considered: Column | None = None) -> Measurement:
    """Rows for which `bad` is true must not exist."""
    return Measurement(
        df,
        {
            "bad": count_if(bad),
            "total": rows() if considered is None else count_if(considered),
        },
        lambda m: Judgement(
            violations=m("bad"),
            passed=zero(m("bad")),
            observed=m("bad"),
            expected=F.lit(0),
            metrics={"violation_count": m("bad"), "checked_rows": m("total")},
        ),
    )


def allowed_values_rows(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    return df.filter(~F.col(column).isin(list(values)))


def allowed_values_measurement(
    df: DataFrame, column: str, values: Sequence[Any] | DataFrame, lookup_column: str | None = None
) -> Measurement:
    """Non-null values outside a list, or outside a lookup table of any size."""
    if isinstance(values, DataFrame):
        return Measurement(
            joins.orphan_keys(df, [column], values, [lookup_column or values.columns[0]]),
            {"keys": rows(), "rows": F.coalesce(F.sum("n"), F.lit(0))},
            lambda m: Judgement(
                violations=m("rows"),
                passed=zero(m("rows")),
                observed=m("rows"),
                expected=F.lit(0),
                metrics={"violation_count": m("rows"), "unknown_values": m("keys")},
            ),
        )
    c = F.col(column)
    return _simple(df, "allowed_values", ~c.isin(list(values)), c.isNotNull())


def check_allowed_values(
    df: DataFrame,
    column: str,
    values: Sequence[Any] | DataFrame,
    lookup_column: str | None = None,
    **label: Any,
) -> DataFrame:
    m = allowed_values_measurement(df, column, values, lookup_column)
    return result("allowed_values", m, **label)


def invariant_violation(predicate: str | Column, null_is_violation: bool = False) -> Column:
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return ~F.coalesce(p, F.lit(not null_is_violation))


def invariant_rows(
    df: DataFrame, predicate: str | Column, null_is_violation: bool = False
) -> DataFrame:
    return df.filter(invariant_violation(predicate, null_is_violation))


def invariant_measurement(
    df: DataFrame, predicate: str | Column, null_is_violation: bool = False
) -> Measurement:
    return _simple(df, "invariant", invariant_violation(predicate, null_is_violation))


def check_invariant(
    df: DataFrame, predicate: str | Column, null_is_violation: bool = False, **label: Any
) -> DataFrame:
    return result("invariant", invariant_measurement(df, predicate, null_is_violation), **label)


# --------------------------------------------------------------- idempotency


def reloaded_ids(df: DataFrame, id_column: str, batch_column: str) -> DataFrame:
    """Ids loaded by more than one batch. Smallest and largest batch differ
    exactly when there are several, so no distinct count is needed."""
    return (
        df.filter(F.col(id_column).isNotNull() & F.col(batch_column).isNotNull())
        .groupBy(id_column)
        .agg(
            F.min(batch_column).alias("first_batch"),
            F.max(batch_column).alias("last_batch"),
            rows().alias("n"),
        )
        .filter(F.col("first_batch") < F.col("last_batch"))
    )


def idempotent_measurement(df: DataFrame, id_column: str, batch_column: str) -> Measurement:
    return Measurement(
        reloaded_ids(df, id_column, batch_column),
        {"ids": rows(), "rows": F.coalesce(F.sum("n"), F.lit(0))},
        lambda m: Judgement(
            violations=m("ids"),
            passed=zero(m("ids")),
            observed=m("ids"),
            expected=F.lit(0),
            metrics={"reloaded_ids": m("ids"), "reloaded_rows": m("rows")},
        ),
    )


def check_idempotent(df: DataFrame, id_column: str, batch_column: str, **label: Any) -> DataFrame:
    return result("idempotent", idempotent_measurement(df, id_column, batch_column), **label)
