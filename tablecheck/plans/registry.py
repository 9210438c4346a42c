"""Which kind of check is measured how.

A builder gets `(df, check, env)` and returns one of
  * a `Measurement` (over `df` itself it joins the fused scan),
  * a boolean `Column`: rows for which it is true are violations (fused),
  * a `DataFrame` of violating rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import drift, evidence, integrity, intervals, joins, payload, rules, snapshots, volume
from ..operators.aggregates import count_if, rows
from ..operators.contracts import schema_differences, schema_drift_measurement, schema_measurement
from ..operators.privacy import no_pii_measurement, pii_rows
from ..spec import Check, DatasetMeta
from ..verdict import Judgement, Measurement, zero
from .catalog import catalog_diff, contract_frame, table_schema
from .profile import profile_of


@dataclass(frozen=True)
class Env:
    tables: Mapping[str, DataFrame]
    metas: Mapping[str, DatasetMeta] = field(default_factory=dict)
    as_of: Any = None

    def meta(self, dataset: str) -> DatasetMeta:
        return self.metas.get(dataset, DatasetMeta(dataset))

    def table(self, name: str | DataFrame) -> DataFrame:
        if isinstance(name, DataFrame):
            return name
        if name not in self.tables:
            raise KeyError(f"unknown dataset {name!r}")
        return self.tables[name]


Builder = Callable[[DataFrame, Check, Env], Any]
_BUILDERS: dict[str, Builder] = {}
_ROWS: dict[str, Builder] = {}


def register_check(kind: str, fn: Builder, rows_fn: Builder | None = None) -> None:
    """Add a kind of check, or replace one."""
    _BUILDERS[kind] = fn
    if rows_fn is not None:
        _ROWS[kind] = rows_fn


def kinds() -> list[str]:
    return sorted(_BUILDERS)


def measurement_of(df: DataFrame, check: Check, env: Env) -> Measurement:
    if check.type not in _BUILDERS:
        raise ValueError(f"Unsupported test type: {check.type}")
    built = _BUILDERS[check.type](df, check, env)
    if isinstance(built, Measurement):
        return built
    if isinstance(built, Column):
        return _counted(df, count_if(built))
    return _counted(built, rows())


def _counted(frame: DataFrame, bad: Column) -> Measurement:
    return Measurement(
        frame,
        {"bad": bad},
        lambda m: Judgement(
            violations=m("bad"),
            passed=zero(m("bad")),
            observed=m("bad"),
            expected=F.lit(0),
            metrics={"violation_count": m("bad")},
        ),
    )


def violating_rows(df: DataFrame, check: Check, env: Env) -> DataFrame | None:
    """Rows to show for a failing check; None where rows make no sense."""
    fn = _ROWS.get(check.type)
    return None if fn is None else fn(df, check, env)


# ------------------------------------------------------------ built-in kinds


def _abs(c: Check, default: float) -> float:
    return default if c.tolerance.abs is None else c.tolerance.abs


def _is_path(c: Check) -> bool:
    return len(c.keys) == 1 and c.keys[0].startswith("$")


def _payload(c: Check) -> str:
    return c.params.get("payload", "payload")


def _uniqueness(df: DataFrame, c: Check, env: Env) -> Measurement:
    dup = c.tolerance.dup_rows or 0
    if _is_path(c):
        return payload.json_unique_measurement(df, _payload(c), c.keys[0], dup)
    return integrity.unique_measurement(df, c.keys, dup)


def _uniqueness_rows(df: DataFrame, c: Check, env: Env) -> DataFrame:
    if _is_path(c):
        return payload.path_value_counts(df, _payload(c), c.keys[0]).filter("duplicate_count > 1")
    return integrity.duplicate_groups(df, c.keys)


def _time_column(c: Check, env: Env) -> str:
    ts = c.params.get("column") or env.meta(c.dataset).watermark_column
    if ts is None:
        raise ValueError(f"{c.name}: freshness needs a timestamp column")
    return ts


def _freshness(df: DataFrame, c: Check, env: Env) -> Measurement:
    hours = c.window.last_hours if c.window and c.window.last_hours else c.tolerance.hours
    elapsed = bool(c.params.get("elapsed"))
    if _is_path(c):
        return payload.json_fresh_measurement(df, _payload(c), c.keys[0], hours, env.as_of, elapsed)
    return volume.fresh_measurement(df, _time_column(c, env), hours, env.as_of, elapsed)


def _row_count(df: DataFrame, c: Check, env: Env) -> Measurement:
    p = c.params
    if "min" in p or "max" in p:
        return volume.row_count_measurement(df, p.get("min"), p.get("max"))
    baseline = p.get("baseline", env.meta(c.dataset).row_count_estimate)
    if baseline is None:
        raise ValueError(f"{c.name}: a row count check needs a range or a baseline")
    pct = 10.0 if c.tolerance.pct is None else c.tolerance.pct
    return volume.stable_count_measurement(df, baseline, pct)


def _rule(df: DataFrame, c: Check, env: Env) -> Measurement:
    if not c.expression:
        raise ValueError(f"{c.name}: a rule needs an expression")
    return rules.rule_measurement(df, c.expression, _abs(c, 0.01), c.tolerance.pct)


def _reference(c: Check, env: Env) -> tuple[tuple[str, ...], DataFrame, tuple[str, ...]]:
    p = c.params
    if "parent" in p:
        cols = c.keys or tuple(p["columns"])
        return cols, env.table(p["parent"]), tuple(p.get("ref_columns", cols))
    for k in env.meta(c.dataset).foreign_keys:
        if not c.keys or k.columns == c.keys:
            return k.columns, env.table(k.ref_table), k.ref_columns
    raise ValueError(f"{c.name}: no parent table given")


def _foreign_key(df: DataFrame, c: Check, env: Env) -> Measurement:
    cols, parent, ref = _reference(c, env)
    return integrity.foreign_key_measurement(df, cols, parent, ref)


def _orphans(df: DataFrame, c: Check, env: Env) -> DataFrame:
    cols, parent, ref = _reference(c, env)
    return joins.orphan_rows(df, cols, parent, ref)


def _coverage(df: DataFrame, c: Check, env: Env) -> Measurement:
    dims = [(cols, env.table(dim), ref) for cols, dim, ref in c.params["dimensions"]]
    return integrity.fact_coverage_measurement(df, dims, c.params.get("min_rate", 1.0))


def _agg_match(df: DataFrame, c: Check, env: Env) -> Measurement:
    p = c.params
    return volume.agg_match_measurement(
        df, env.table(p["source"]), p["metrics"], p.get("group_by", ()), _abs(c, 0.01), c.tolerance.pct
    )


def _count_match(df: DataFrame, c: Check, env: Env) -> Measurement:
    return volume.count_match_measurement(
        df, env.table(c.params["source"]), int(_abs(c, 0)), c.tolerance.pct or 0.0
    )


def _evidence(df: DataFrame, c: Check, env: Env) -> Measurement:
    p = c.params
    return evidence.evidence_measurement(
        df, p.get("window"), p["manifest"], p.get("tolerance", evidence.EvidenceTolerance())
    )


def _reconciliation(df: DataFrame, c: Check, env: Env) -> Measurement:
    p = c.params
    if "manifest" in p:
        return _evidence(df, c, env)
    if "dimensions" in p:
        return _coverage(df, c, env)
    if "metrics" in p:
        return _agg_match(df, c, env)
    if "source" in p:
        return _count_match(df, c, env)
    return _foreign_key(df, c, env)


def _evidence_rows(df: DataFrame, c: Check, env: Env) -> DataFrame:
    p = c.params
    tolerance = p.get("tolerance", evidence.EvidenceTolerance())
    return evidence.reconcile_evidence(df, p.get("window"), p["manifest"], tolerance).filter(~F.col("within"))


def _coverage_rows(df: DataFrame, c: Check, env: Env) -> DataFrame:
    return integrity.uncovered_rows(df, [(cols, env.table(dim), ref) for cols, dim, ref in c.params["dimensions"]])


def _agg_match_rows(df: DataFrame, c: Check, env: Env) -> DataFrame:
    p = c.params
    out = volume.agg_match_frame(
        df, env.table(p["source"]), p["metrics"], p.get("group_by", ()), _abs(c, 0.01), c.tolerance.pct
    )
    return out.filter(~reduce(lambda a, b: a & b, [F.col(f"{m}_ok") for m in p["metrics"]]))


def _reconciliation_rows(df: DataFrame, c: Check, env: Env) -> DataFrame | None:
    """What differs; nothing for two counts, which are no rows."""
    if "manifest" in c.params:
        return _evidence_rows(df, c, env)
    if "dimensions" in c.params:
        return _coverage_rows(df, c, env)
    if "metrics" in c.params:
        return _agg_match_rows(df, c, env)
    return None if "source" in c.params else _orphans(df, c, env)


def _evidence_keys(df: DataFrame, c: Check, env: Env) -> dict[str, Any]:
    p = c.params
    return {
        "df": df,
        "key": c.keys[0],
        "sample_keys": env.table(p["sample"]),
        "sample_column": p.get("sample_column", "key"),
        "masked": bool(p.get("masked")),
    }


def _contract(c: Check) -> dict[str, Any]:
    p = c.params
    return {
        "fields": p.get("fields", ()),
        "payload": p.get("payload"),
        "paths": p.get("paths"),
        "keys": c.keys,
    }


def _schema(df: DataFrame, c: Check, env: Env) -> Measurement:
    contract = contract_frame(df.sparkSession, c.params["contract"])
    return schema_measurement(table_schema(df), contract, bool(c.params.get("allow_extra")))


def _drift(df: DataFrame, c: Check, env: Env) -> Measurement:
    p = c.params
    if "baseline_profile" in p:
        return drift.profile_drift_measurement(
            profile_of(df), env.table(p["baseline_profile"]), **p.get("limits", {})
        )
    if "previous_schema" in p:
        return schema_drift_measurement(_named_schema(df, c), env.table(p["previous_schema"]))
    if "previous" in p:
        return snapshots.compare_measurement(df, env.table(p["previous"]), c.keys)
    return drift.category_drift_measurement(
        df, env.table(p["baseline"]), p["column"], p.get("threshold", 0.2), p.get("bins", 10)
    )


def _schema_rows(df: DataFrame, c: Check, env: Env) -> DataFrame:
    contract = contract_frame(df.sparkSession, c.params["contract"])
    return schema_differences(table_schema(df), contract, bool(c.params.get("allow_extra")))


def _drift_rows(df: DataFrame, c: Check, env: Env) -> DataFrame:
    """What drifted: columns, schema changes, keys, or all categories with their counts."""
    p = c.params
    if "baseline_profile" in p:
        limits = p.get("limits", {})
        return drift.profile_drift_rows(profile_of(df), env.table(p["baseline_profile"]), **limits).filter("drifted")
    if "previous_schema" in p:
        out = catalog_diff(_named_schema(df, c), env.table(p["previous_schema"]))
        return out.filter(F.col("change") != "dataset_modified")
    if "previous" in p:
        return snapshots.key_changes(df, env.table(p["previous"]), c.keys)
    return drift.category_shares(df, env.table(p["baseline"]), p["column"], p.get("bins", 10))


def _named_schema(df: DataFrame, c: Check) -> DataFrame:
    return table_schema(df).withColumn("dataset", F.lit(c.dataset))


def _allowed(df: DataFrame, c: Check, env: Env) -> Measurement:
    p = c.params
    values = env.table(p["lookup"]) if "lookup" in p else p["values"]
    return integrity.allowed_values_measurement(df, p["column"], values, p.get("lookup_column"))


def _allowed_rows(df: DataFrame, c: Check, env: Env) -> DataFrame:
    p = c.params
    if "lookup" not in p:
        return integrity.allowed_values_rows(df, p["column"], p["values"])
    lookup = env.table(p["lookup"])
    return joins.orphan_rows(df, [p["column"]], lookup, [p.get("lookup_column") or lookup.columns[0]])


def _late(df: DataFrame, c: Check, env: Env) -> Measurement:
    p = c.params
    if "partition" in p:
        return intervals.running_late_measurement(
            df, p["event_ts"], p["arrival_order"], p["partition"], p.get("sla_seconds", 0), p.get("max_rate", 0.0)
        )
    return intervals.late_measurement(
        df, p["event_ts"], p["arrival_ts"], p["sla_seconds"], p.get("max_rate", 0.0)
    )


def _late_rows(df: DataFrame, c: Check, env: Env) -> DataFrame:
    p = c.params
    if "partition" in p:
        out = intervals.behind_running_max(
            df, p["event_ts"], p["arrival_order"], p["partition"], p.get("sla_seconds", 0)
        )
        return out.filter("late")
    return intervals.late_rows(df, p["event_ts"], p["arrival_ts"], p["sla_seconds"])


def _install() -> None:
    add = register_check
    add("uniqueness", _uniqueness, _uniqueness_rows)
    add(
        "not_null",
        lambda df, c, env: integrity.not_null_measurement(df, c.keys),
        lambda df, c, env: integrity.null_rows(df, c.keys),
    )
    add("freshness", _freshness)
    add("row_count", _row_count)
    add(
        "rule",
        _rule,
        lambda df, c, env: rules.rule_rows(df, c.expression, _abs(c, 0.01), c.tolerance.pct),
    )
    add("reconciliation", _reconciliation, _reconciliation_rows)
    add("schema", _schema, _schema_rows)
    add("drift", _drift, _drift_rows)
    add("foreign_key", _foreign_key, _orphans)
    add(
        "dim_complete",
        lambda df, c, env: integrity.dim_complete_measurement(df, c.keys or env.meta(c.dataset).business_keys),
        lambda df, c, env: integrity.blank_rows(df, c.keys or env.meta(c.dataset).business_keys),
    )
    add("fact_coverage", _coverage, _coverage_rows)
    add("agg_match", _agg_match, _agg_match_rows)
    add("count_match", _count_match)
    add("evidence", _evidence, _evidence_rows)
    add(
        "evidence_keys",
        lambda df, c, env: evidence.evidence_keys_measurement(**_evidence_keys(df, c, env)),
        lambda df, c, env: evidence.missing_evidence_keys(**_evidence_keys(df, c, env)),
    )
    add(
        "evidence_checksum",
        lambda df, c, env: evidence.evidence_checksum_measurement(
            df, c.params.get("window"), c.params["columns"], c.params["expected"]
        ),
    )
    add(
        "evidence_contract",
        lambda df, c, env: evidence.evidence_contract_measurement(df, **_contract(c)),
        lambda df, c, env: evidence.contract_rows(df, **_contract(c)),
    )
    add("allowed_values", _allowed, _allowed_rows)
    add(
        "invariant",
        lambda df, c, env: integrity.invariant_measurement(df, c.expression, bool(c.params.get("null_is_violation"))),
        lambda df, c, env: integrity.invariant_rows(df, c.expression, bool(c.params.get("null_is_violation"))),
    )
    add("late_arrivals", _late, _late_rows)
    add(
        "scd2",
        lambda df, c, env: intervals.scd2_measurement(
            df, c.keys, c.params["valid_from"], c.params["valid_to"], c.params.get("current")
        ),
        lambda df, c, env: intervals.scd2_rows(
            df, c.keys, c.params["valid_from"], c.params["valid_to"], c.params.get("current")
        ),
    )
    add(
        "idempotent",
        lambda df, c, env: integrity.idempotent_measurement(df, c.keys[0], c.params["batch_column"]),
        lambda df, c, env: integrity.reloaded_ids(df, c.keys[0], c.params["batch_column"]),
    )
    add(
        "no_pii",
        lambda df, c, env: no_pii_measurement(df, values=bool(c.params.get("values"))),
        lambda df, c, env: pii_rows(df),
    )
    add(
        "json_valid",
        lambda df, c, env: payload.json_valid_measurement(df, _payload(c)),
        lambda df, c, env: payload.invalid_rows(df, _payload(c)),
    )
    add(
        "json_path",
        lambda df, c, env: payload.json_path_measurement(df, _payload(c), c.params["path"]),
        lambda df, c, env: payload.missing_path_rows(df, _payload(c), c.params["path"]),
    )
    add(
        "json_type",
        lambda df, c, env: payload.json_type_measurement(
            df, _payload(c), c.params["path"], c.params["expected"], bool(c.params.get("allow_null"))
        ),
        lambda df, c, env: payload.wrong_type_rows(df, _payload(c), c.params["path"], c.params["expected"]),
    )
    add(
        "json_unique",
        lambda df, c, env: payload.json_unique_measurement(
            df, _payload(c), c.params["path"], c.tolerance.dup_rows or 0
        ),
        lambda df, c, env: payload.repeated_values(df, _payload(c), c.params["path"]),
    )
    add(
        "json_flatten",
        lambda df, c, env: payload.flatten_measurement(df, _payload(c), c.params["path"], int(_abs(c, 0))),
    )
    add(
        "json_flatten_child",
        lambda df, c, env: payload.flatten_child_measurement(
            df, _payload(c), c.params["path"], env.table(c.params["child"]), int(_abs(c, 0))
        ),
    )
    add(
        "json_mapping",
        lambda df, c, env: payload.json_mapping_measurement(df, _payload(c), c.params["path"], c.params["column"]),
        lambda df, c, env: payload.mapping_rows(df, _payload(c), c.params["path"], c.params["column"]),
    )
    for kind in ("json_enum", "json_version"):
        add(
            kind,
            lambda df, c, env: payload.json_enum_measurement(
                df, _payload(c), c.params["path"], c.params["values"]
            ),
            lambda df, c, env: payload.unlisted_rows(df, _payload(c), c.params["path"], c.params["values"]),
        )
    add(
        "json_timestamp",
        lambda df, c, env: payload.json_timestamp_measurement(
            df, _payload(c), c.params["path"], c.params.get("format")
        ),
        lambda df, c, env: payload.bad_timestamp_rows(df, _payload(c), c.params["path"], c.params.get("format")),
    )
    add(
        "json_late",
        lambda df, c, env: payload.json_late_measurement(
            df, _payload(c), c.params["path"], c.params["arrival_ts"], c.params["sla_seconds"], c.params.get("max_rate", 0.0)
        ),
        lambda df, c, env: payload.json_late_rows(
            df, _payload(c), c.params["path"], c.params["arrival_ts"], c.params["sla_seconds"]
        ),
    )
    add(
        "json_child_fk",
        lambda df, c, env: payload.child_fk_measurement(
            df, _payload(c), c.params["path"], c.params["id_path"], env.table(c.params["parent"]), c.params["ref"]
        ),
        lambda df, c, env: payload.child_orphans(
            df, _payload(c), c.params["path"], c.params["id_path"], env.table(c.params["parent"]), c.params["ref"]
        ),
    )
    add(
        "json_drift",
        lambda df, c, env: payload.json_drift_measurement(
            payload.key_profile(df, _payload(c)), env.table(c.params["baseline"]), **c.params.get("limits", {})
        ),
        lambda df, c, env: payload.json_drift_rows(
            payload.key_profile(df, _payload(c)), env.table(c.params["baseline"]), **c.params.get("limits", {})
        ).filter("drifted"),
    )


_install()
