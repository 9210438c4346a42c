"""Checks on one JSON payload column (text or VARIANT)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import payloads as P
from ..functions.times import epoch_micros, instant_micros
from ..verdict import Judgement, Measurement, result, zero
from . import joins
from .aggregates import count_if, rows
from .intervals import is_late, late_measurement
from .volume import fresh_measurement


def parsed_name(payload: str) -> str:
    return f"_v_{payload}"


def with_parsed(df: DataFrame, payload: str) -> DataFrame:
    """Parse once: later checks on this frame all read the parsed column."""
    if parsed_name(payload) in df.columns:
        return df
    v = P.variant(F.col(payload), df.schema[payload].dataType)
    return df.withColumn(parsed_name(payload), v)


def parsed_rows(df: DataFrame, payload: str) -> DataFrame:
    """Like `with_parsed`, for results that may be filtered afterwards. A filter
    moves below a projection and takes a copy of the parsing with it; it cannot
    move below a generated column."""
    if parsed_name(payload) in df.columns:
        return df
    v = P.variant(F.col(payload), df.schema[payload].dataType)
    return df.select("*", F.explode(F.array(v)).alias(parsed_name(payload)))


def parsed(df: DataFrame, payload: str) -> Column:
    if parsed_name(payload) in df.columns:
        return F.col(parsed_name(payload))
    return P.variant(F.col(payload), df.schema[payload].dataType)


def _counted(bad: str, metrics: dict[str, str]) -> Any:
    def judge(m: Any) -> Judgement:
        return Judgement(
            violations=m(bad),
            passed=zero(m(bad)),
            observed=m(bad),
            expected=F.lit(0),
            metrics={label: m(name) for label, name in metrics.items()},
        )

    return judge


def _missing_of(total: str, good: str, labels: tuple[str, str, str]) -> Any:
    """Violations are what is in `total` and not in `good`."""

    def judge(m: Any) -> Judgement:
        bad = m(total) - m(good)
        return Judgement(
            violations=bad,
            passed=zero(bad),
            observed=bad,
            expected=F.lit(0),
            metrics=dict(zip(labels, (m(total), m(good), bad))),
        )

    return judge


# ------------------------------------------------------------------- validity


def invalid_rows(df: DataFrame, payload: str) -> DataFrame:
    return df.filter(F.col(payload).isNotNull() & parsed(df, payload).isNull())


def json_valid_measurement(df: DataFrame, payload: str) -> Measurement:
    df = with_parsed(df, payload)
    return Measurement(
        df,
        {"total": F.count(payload), "valid": F.count(parsed(df, payload))},
        _missing_of("total", "valid", ("total_rows", "valid_json_count", "invalid_json_count")),
    )


def check_json_valid(df: DataFrame, payload: str, **label: Any) -> DataFrame:
    return result("json_valid", json_valid_measurement(df, payload), **label)


# ------------------------------------------------------------- paths and types


def missing_path_rows(df: DataFrame, payload: str, path: str) -> DataFrame:
    return df.filter(F.col(payload).isNotNull() & P.at(parsed(df, payload), path).isNull())


def json_path_measurement(df: DataFrame, payload: str, path: str) -> Measurement:
    """A JSON null counts as present."""
    df = with_parsed(df, payload)
    return Measurement(
        df,
        {"total": F.count(payload), "present": F.count(P.at(parsed(df, payload), path))},
        _missing_of(
            "total", "present", ("total_rows", "path_exists_count", "missing_path_count")
        ),
    )


def check_json_path(df: DataFrame, payload: str, path: str, **label: Any) -> DataFrame:
    return result("json_path", json_path_measurement(df, payload, path), **label)


JSON_CLASSES = ("STRING", "NUMBER", "BOOLEAN", "ARRAY", "OBJECT")


def json_type_measurement(
    df: DataFrame, payload: str, path: str, expected: str, allow_null: bool = False
) -> Measurement:
    expected = expected.upper()
    if expected not in JSON_CLASSES:
        raise ValueError(f"JSON type must be one of {JSON_CLASSES}, not {expected!r}")
    df = with_parsed(df, payload)
    cls = P.type_class(P.at(parsed(df, payload), path))
    right = cls.isin(expected, "NULL") if allow_null else cls == expected
    return Measurement(
        df,
        {"total": F.count(cls), "right": F.count_if(right)},
        _missing_of("total", "right", ("total_rows", "correct_type_count", "wrong_type_count")),
    )


def wrong_type_rows(df: DataFrame, payload: str, path: str, expected: str) -> DataFrame:
    df = parsed_rows(df.drop(parsed_name(payload)), payload)
    return df.filter(P.type_class(P.at(parsed(df, payload), path)) != expected.upper())


def check_json_type(
    df: DataFrame, payload: str, path: str, expected: str, allow_null: bool = False, **label: Any
) -> DataFrame:
    return result("json_type", json_type_measurement(df, payload, path, expected, allow_null), **label)


# ----------------------------------------------------------------- uniqueness


def path_value_counts(df: DataFrame, payload: str, path: str) -> DataFrame:
    """Rows per value of a path. VARIANT cannot be grouped, its text can.

    Rows without a value end up in one group with count 0: leaving them out with
    a filter before the count would parse every payload a second time.
    """
    value = P.at_as(parsed(df, payload), path, "string")
    return (
        df.select(value.alias("json_value"))
        .groupBy("json_value")
        .agg(F.count("json_value").alias("duplicate_count"))
    )


def json_unique_measurement(
    df: DataFrame, payload: str, path: str, dup_rows: int = 0
) -> Measurement:
    dup = F.col("duplicate_count") > 1
    return Measurement(
        path_value_counts(df, payload, path),
        {
            "groups": F.count_if(dup),
            "rows": F.coalesce(F.sum(F.when(dup, F.col("duplicate_count"))), F.lit(0)),
            "total": F.coalesce(F.sum("duplicate_count"), F.lit(0)),
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


def repeated_values(df: DataFrame, payload: str, path: str) -> DataFrame:
    return path_value_counts(df, payload, path).filter("duplicate_count > 1")


def check_json_unique(
    df: DataFrame, payload: str, path: str, dup_rows: int = 0, **label: Any
) -> DataFrame:
    return result("json_unique", json_unique_measurement(df, payload, path, dup_rows), **label)


# -------------------------------------------------------------------- flatten


def explode_items(
    df: DataFrame, payload: str, path: str, keep_empty: bool = False, out: str = "item"
) -> DataFrame:
    """One row per array element; rows without elements vanish unless kept."""
    explode = F.explode_outer if keep_empty else F.explode
    return df.select("*", explode(P.items(parsed(df, payload), path)).alias(out))


def flatten_measurement(
    df: DataFrame, payload: str, path: str, tolerance: int = 0
) -> Measurement:
    """Source rows against array elements. Lengths are summed, nothing explodes."""
    df = with_parsed(df, payload)
    size = P.array_size(parsed(df, payload), path)

    def judge(m: Any) -> Judgement:
        diff = F.abs(m("source") - m("elements"))
        return Judgement(
            violations=F.when(diff <= tolerance, 0).otherwise(diff),
            passed=diff <= tolerance,
            observed=m("elements"),
            expected=m("source"),
            tolerance=F.lit(tolerance),
            metrics={
                "source_rows": m("source"),
                "flattened_rows": m("elements"),
                "cardinality_diff": diff,
            },
        )

    return Measurement(
        df, {"source": rows(), "elements": F.coalesce(F.sum(size), F.lit(0))}, judge
    )


def check_flatten(
    df: DataFrame, payload: str, path: str, tolerance: int = 0, **label: Any
) -> DataFrame:
    return result("json_flatten", flatten_measurement(df, payload, path, tolerance), **label)


def flatten_child_measurement(
    df: DataFrame, payload: str, path: str, child: DataFrame, tolerance: int = 0
) -> Measurement:
    none = F.lit(None).cast("bigint")
    elements = F.coalesce(F.sum(P.array_size(parsed(df, payload), path)), F.lit(0))
    counts = df.agg(elements.alias("elements"), none.alias("children")).unionByName(
        child.agg(none.alias("elements"), rows().alias("children"))
    )

    def judge(m: Any) -> Judgement:
        diff = F.abs(m("elements") - m("children"))
        return Judgement(
            violations=F.when(diff <= tolerance, 0).otherwise(diff),
            passed=diff <= tolerance,
            observed=m("children"),
            expected=m("elements"),
            tolerance=F.lit(tolerance),
            metrics={
                "array_elements": m("elements"),
                "child_rows": m("children"),
                "cardinality_diff": diff,
            },
        )

    return Measurement(
        counts, {"elements": F.max("elements"), "children": F.max("children")}, judge
    )


def check_flatten_child(
    df: DataFrame, payload: str, path: str, child: DataFrame, tolerance: int = 0, **label: Any
) -> DataFrame:
    m = flatten_child_measurement(df, payload, path, child, tolerance)
    return result("json_flatten_child", m, **label)


def child_fk_measurement(
    df: DataFrame, payload: str, path: str, id_path: str, parent: DataFrame, ref: str
) -> Measurement:
    """Ids of the exploded elements that the parent table does not have."""
    ref_type = parent.schema[ref].dataType.simpleString()
    ids = df.select(F.explode(P.items(parsed(df, payload), path)).alias("item")).select(
        P.at_as(F.col("item"), id_path, ref_type).alias("child_id")
    )
    return Measurement(
        joins.orphan_keys(ids, ["child_id"], parent, [ref]),
        {"keys": rows(), "rows": F.coalesce(F.sum("n"), F.lit(0))},
        lambda m: Judgement(
            violations=m("rows"),
            passed=zero(m("rows")),
            observed=m("rows"),
            expected=F.lit(0),
            metrics={"orphan_rows": m("rows"), "orphan_keys": m("keys")},
        ),
    )


def child_orphans(
    df: DataFrame, payload: str, path: str, id_path: str, parent: DataFrame, ref: str
) -> DataFrame:
    """Rows with an element whose id the parent lacks, once per such element, with
    `child_id`."""
    ref_type = parent.schema[ref].dataType.simpleString()
    items = parsed_rows(df.drop(parsed_name(payload)), payload)
    ids = items.select("*", F.explode(P.items(F.col(parsed_name(payload)), path)).alias("_item"))
    ids = ids.withColumn("child_id", P.at_as(F.col("_item"), id_path, ref_type)).drop("_item")
    return joins.orphan_rows(ids, ["child_id"], parent, [ref])


def check_json_child_fk(
    df: DataFrame,
    payload: str,
    path: str,
    id_path: str,
    parent: DataFrame,
    ref: str,
    **label: Any,
) -> DataFrame:
    m = child_fk_measurement(df, payload, path, id_path, parent, ref)
    return result("json_child_fk", m, **label)


# ------------------------------------------- mapping, enums, versions, times


def _mapping(df: DataFrame, payload: str, path: str, column: str) -> tuple[Column, Column, Column]:
    """Whether a row has payload and column, lacks the path, and holds the same."""
    v = P.at(parsed(df, payload), path)
    typed = P.at_as(parsed(df, payload), path, df.schema[column].dataType.simpleString())
    both = F.col(payload).isNotNull() & F.col(column).isNotNull()
    missing = v.isNull() | (P.type_class(v) == "NULL")
    return both, missing, F.coalesce(typed == F.col(column), F.lit(False))


def mapping_rows(df: DataFrame, payload: str, path: str, column: str) -> DataFrame:
    """Rows whose value at the path differs from the column."""
    df = parsed_rows(df.drop(parsed_name(payload)), payload)
    both, missing, equal = _mapping(df, payload, path, column)
    return df.filter(both & ~missing & ~equal)


def json_mapping_measurement(
    df: DataFrame, payload: str, path: str, column: str
) -> Measurement:
    """Rows with payload and column: equal, different, or path missing (a value
    that does not convert to the column's type differs)."""
    df = with_parsed(df, payload)
    both, missing, equal = _mapping(df, payload, path, column)
    return Measurement(
        df,
        {
            "total": F.count_if(both),
            "match": F.count_if(both & ~missing & equal),
            "mismatch": F.count_if(both & ~missing & ~equal),
            "missing": F.count_if(both & missing),
        },
        _counted(
            "mismatch",
            {
                "total_rows": "total",
                "matching_rows": "match",
                "mismatched_rows": "mismatch",
                "missing_path": "missing",
            },
        ),
    )


def check_json_mapping(
    df: DataFrame, payload: str, path: str, column: str, **label: Any
) -> DataFrame:
    return result("json_mapping", json_mapping_measurement(df, payload, path, column), **label)


def unlisted_rows(df: DataFrame, payload: str, path: str, values: Sequence[Any]) -> DataFrame:
    """Rows whose value at the path is none of `values`."""
    return df.filter(~P.at_as(parsed(df, payload), path, "string").isin([str(x) for x in values]))


def json_enum_measurement(
    df: DataFrame, payload: str, path: str, values: Sequence[Any]
) -> Measurement:
    df = with_parsed(df, payload)
    value = P.at_as(parsed(df, payload), path, "string")
    bad = ~value.isin([str(x) for x in values])
    return Measurement(
        df,
        {"total": F.count_if(value.isNotNull()), "bad": count_if(bad)},
        _counted("bad", {"total_rows": "total", "violation_count": "bad"}),
    )


def check_json_enum(
    df: DataFrame, payload: str, path: str, values: Sequence[Any], **label: Any
) -> DataFrame:
    return result("json_enum", json_enum_measurement(df, payload, path, values), **label)


def check_json_version(
    df: DataFrame,
    payload: str,
    path: str,
    known: Sequence[Any],
    on_unknown: str = "fail",
    **label: Any,
) -> DataFrame:
    """Unknown schema versions; `on_unknown` is the gate (fail or warn)."""
    label = {**label, "gate": on_unknown}
    return result("json_version", json_enum_measurement(df, payload, path, known), **label)


def bad_timestamp_rows(df: DataFrame, payload: str, path: str, fmt: str | None = None) -> DataFrame:
    """Rows whose text at the path is no timestamp."""
    text = P.at_as(parsed(df, payload), path, "string")
    ts = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return df.filter(text.isNotNull() & ts.isNull())


def json_timestamp_measurement(
    df: DataFrame, payload: str, path: str, fmt: str | None = None
) -> Measurement:
    df = with_parsed(df, payload)
    text = P.at_as(parsed(df, payload), path, "string")
    ts = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return Measurement(
        df,
        {
            "total": F.count_if(text.isNotNull()),
            "bad": F.count_if(text.isNotNull() & ts.isNull()),
        },
        _counted("bad", {"total_rows": "total", "invalid_timestamps": "bad"}),
    )


def check_json_timestamp(
    df: DataFrame, payload: str, path: str, fmt: str | None = None, **label: Any
) -> DataFrame:
    return result("json_timestamp", json_timestamp_measurement(df, payload, path, fmt), **label)


def path_time(df: DataFrame, payload: str, path: str) -> Column:
    return P.at_as(parsed(df, payload), path, "timestamp_ntz")


def json_fresh_measurement(
    df: DataFrame,
    payload: str,
    path: str,
    last_hours: int | None = 24,
    as_of: Any = None,
    elapsed: bool = False,
) -> Measurement:
    df = with_parsed(df, payload)
    return fresh_measurement(df, path_time(df, payload, path), last_hours, as_of, elapsed)


def check_json_fresh(
    df: DataFrame,
    payload: str,
    path: str,
    last_hours: int = 24,
    as_of: Any = None,
    elapsed: bool = False,
    **label: Any,
) -> DataFrame:
    m = json_fresh_measurement(df, payload, path, last_hours, as_of, elapsed)
    return result("json_freshness", m, **label)


def json_late_rows(df: DataFrame, payload: str, path: str, arrival_ts: str, sla_seconds: int) -> DataFrame:
    df = with_parsed(df, payload)
    arrival = instant_micros(F.col(arrival_ts), df.schema[arrival_ts].dataType)
    return df.filter(is_late(epoch_micros(path_time(df, payload, path)), arrival, sla_seconds))


def json_late_measurement(
    df: DataFrame,
    payload: str,
    path: str,
    arrival_ts: str,
    sla_seconds: int,
    max_rate: float = 0.0,
) -> Measurement:
    df = with_parsed(df, payload)
    return late_measurement(
        df, path_time(df, payload, path), arrival_ts, sla_seconds, max_rate
    )


def check_json_late(
    df: DataFrame,
    payload: str,
    path: str,
    arrival_ts: str,
    sla_seconds: int,
    max_rate: float = 0.0,
    **label: Any,
) -> DataFrame:
    m = json_late_measurement(df, payload, path, arrival_ts, sla_seconds, max_rate)
    return result("json_late", m, **label)


# ----------------------------------------------------------------------- drift


def key_profile(df: DataFrame, payload: str) -> DataFrame:
    """Top-level keys of object payloads, per key and type class: `n` rows,
    total `length` of arrays, and `objects`, the number of payload objects.

    An extra element without a key stands for the object itself, so that the
    number of objects comes from the same pass.
    """
    v = F.col(parsed_name(payload))
    fields = with_parsed(df.select(payload), payload).select(
        F.explode(object_fields(v)).alias("f")
    )
    counted = (
        fields.select(
            F.col("f.key").alias("key"),
            P.type_class(F.col("f.value")).alias("type"),
            P.array_size(F.col("f.value"), "$").alias("length"),
        )
        .groupBy("key", "type")
        .agg(
            rows().alias("n"),
            F.count("key").alias("keyed"),
            F.coalesce(F.sum("length"), F.lit(0)).alias("length"),
        )
    )
    # The subquery reads the same counts, and both conditions are on counted
    # values, which no filter can move below the count: Spark counts once.
    own = F.when(F.col("keyed") == 0, F.col("n") + F.col("length"))
    total = counted.agg(F.max(own).alias("objects")).scalar()
    return (
        counted.withColumn("objects", total)
        .filter(F.col("keyed") > 0)
        .select("key", "type", "n", "length", "objects")
    )


def object_fields(v: Column) -> Column:
    """Entries (key, value) of an object plus one (null, null); null otherwise."""
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    itself = F.array(
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value"))
    )
    return F.when(entries.isNotNull(), F.concat(entries, itself))


def json_drift_rows(
    current: DataFrame,
    baseline: DataFrame,
    max_presence_change: float = 0.05,
    max_length_change: float = 0.5,
) -> DataFrame:
    """Compare two key profiles: one row per (key, type) with what changed."""
    c, b = current.alias("c"), baseline.alias("b")

    def rate(side: str) -> Column:
        return F.coalesce(F.col(f"{side}.n") / F.col(f"{side}.objects"), F.lit(0.0))

    def length(side: str) -> Column:
        return F.when(
            F.coalesce(F.col("c.type"), F.col("b.type")) == "ARRAY",
            F.col(f"{side}.length") / F.col(f"{side}.n"),
        )

    cond = (F.col("c.key") == F.col("b.key")) & (F.col("c.type") == F.col("b.type"))
    presence_change = F.abs(rate("c") - rate("b"))
    length_change = F.abs(length("c") - length("b")) / F.greatest(length("b"), F.lit(1.0))
    return (
        c.join(b, cond, "full_outer")
        .select(
            F.coalesce("c.key", "b.key").alias("key"),
            F.coalesce("c.type", "b.type").alias("type"),
            F.when(F.col("b.n").isNull(), "appeared")
            .when(F.col("c.n").isNull(), "vanished")
            .otherwise("both")
            .alias("presence"),
            presence_change.alias("presence_change"),
            length_change.alias("length_change"),
        )
        .withColumn(
            "drifted",
            (F.col("presence") != "both")
            | (F.col("presence_change") > max_presence_change)
            | F.coalesce(F.col("length_change") > max_length_change, F.lit(False)),
        )
    )


def json_drift_measurement(current: DataFrame, baseline: DataFrame, **limits: float) -> Measurement:
    return Measurement(
        json_drift_rows(current, baseline, **limits),
        {
            "drifted": F.count_if("drifted"),
            "appeared": F.count_if(F.col("presence") == "appeared"),
            "vanished": F.count_if(F.col("presence") == "vanished"),
            "total": rows(),
        },
        _counted(
            "drifted",
            {
                "drifted": "drifted",
                "appeared": "appeared",
                "vanished": "vanished",
                "key_types": "total",
            },
        ),
    )


def check_json_drift(
    df: DataFrame, payload: str, baseline: DataFrame, *, label: dict | None = None, **limits: float
) -> DataFrame:
    """`baseline` is a `key_profile`."""
    m = json_drift_measurement(key_profile(df, payload), baseline, **limits)
    return result("json_drift", m, **(label or {}))


# ------------------------------------------------------------------ projection


def project_paths(
    df: DataFrame,
    payload: str,
    mapping: dict[str, tuple[str, str]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """`{"user": ("$.user_id", "bigint")}` as typed columns; what is missing or
    does not convert is null."""
    base = parsed_rows(df.select(*dict.fromkeys([*keep, payload])), payload)
    v = F.col(parsed_name(payload))
    return base.select(
        *keep, *[P.at_as(v, path, t).alias(name) for name, (path, t) in mapping.items()]
    )
