"""Schema contracts. Schemas are small metadata, held as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..verdict import Judgement, Measurement, result, zero
from .aggregates import rows

# Type names that mean the same class of values.
TYPE_CLASSES = {
    "NUMBER": ("number", "numeric", "decimal", "bigint", "int", "integer", "smallint", "tinyint", "double", "float", "long"),
    "STRING": ("string", "varchar", "char", "text"),
    "BOOLEAN": ("boolean", "bool"),
    "TIMESTAMP": ("timestamp", "timestamp_ntz", "timestamp_ltz", "datetime"),
    "DATE": ("date",),
    "ARRAY": ("array",),
    "OBJECT": ("struct", "map", "object"),
    "VARIANT": ("variant", "json"),
}


def type_class(name: Column) -> Column:
    """NUMBER, STRING, ... for any spelling; unknown names stay as they are."""
    base = F.lower(F.regexp_extract(name, r"^\s*([A-Za-z_]+)", 1))
    out = F.upper(name)
    for cls, spellings in TYPE_CLASSES.items():
        out = F.when(base.isin(list(spellings)), cls).otherwise(out)
    return out


def schema_differences(
    actual: DataFrame, contract: DataFrame, allow_extra: bool = False
) -> DataFrame:
    """Rows (column, change, expected, actual) between two schema frames with
    columns `column, type, nullable`. A column that may be null where the
    contract forbids it (or the reverse) is a nullable change; a contract that
    does not say is not compared."""
    a, b = actual.alias("a"), contract.alias("b")
    joined = a.join(b, F.col("a.column") == F.col("b.column"), "full_outer").select(
        F.coalesce("a.column", "b.column").alias("column"),
        F.col("a.column").isNotNull().alias("has"),
        F.col("b.column").isNotNull().alias("wants"),
        type_class(F.col("a.type")).alias("a_class"),
        type_class(F.col("b.type")).alias("b_class"),
        F.col("a.nullable").alias("a_null"),
        F.col("b.nullable").alias("b_null"),
    )
    has, wants = F.col("has"), F.col("wants")
    both = has & wants

    def change(cond: Column, name: str, expected: Column, actual_: Column) -> Column:
        return F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(
                F.lit(name).alias("change"),
                expected.cast("string").alias("expected"),
                actual_.cast("string").alias("actual"),
            ),
        )

    changes = [
        change(~has, "missing", F.col("b_class"), F.col("a_class")),
        change(both & (F.col("a_class") != F.col("b_class")), "type", F.col("b_class"), F.col("a_class")),
        change(both & (F.col("a_null") != F.col("b_null")), "nullable", F.col("b_null"), F.col("a_null")),
    ]
    if not allow_extra:
        changes.append(change(~wants, "extra", F.col("b_class"), F.col("a_class")))
    found = F.filter(F.array(*changes), lambda x: x.isNotNull())
    return joined.select("column", F.explode(found).alias("d")).select("column", "d.*")


def schema_measurement(
    actual: DataFrame, contract: DataFrame, allow_extra: bool = False
) -> Measurement:
    kinds = ("missing", "extra", "type", "nullable")
    return Measurement(
        schema_differences(actual, contract, allow_extra),
        {"n": rows(), **{k: F.count_if(F.col("change") == k) for k in kinds}},
        lambda m: Judgement(
            violations=m("n"),
            passed=zero(m("n")),
            observed=m("n"),
            expected=F.lit(0),
            metrics={k: m(k) for k in kinds},
        ),
    )


def check_schema(
    df: DataFrame,
    contract: DataFrame | Sequence[tuple[str, str, bool | None]],
    allow_extra: bool = False,
    **label: Any,
) -> DataFrame:
    from ..plans.catalog import contract_frame, table_schema

    m = schema_measurement(table_schema(df), contract_frame(df.sparkSession, contract), allow_extra)
    return result("schema", m, **label)


def schema_drift_measurement(current: DataFrame, previous: DataFrame) -> Measurement:
    from ..plans.catalog import catalog_diff

    kinds = (
        "dataset_added",
        "dataset_removed",
        "column_added",
        "column_removed",
        "type_changed",
        "nullable_changed",
    )
    frame = catalog_diff(current, previous)
    return Measurement(
        frame,
        {
            "n": F.count_if(F.col("change") != "dataset_modified"),
            **{k: F.count_if(F.col("change") == k) for k in kinds},
        },
        lambda m: Judgement(
            violations=m("n"),
            passed=zero(m("n")),
            observed=m("n"),
            expected=F.lit(0),
            metrics={k: m(k) for k in kinds},
        ),
    )


def check_schema_drift(current: DataFrame, previous: DataFrame, **label: Any) -> DataFrame:
    return result("drift", schema_drift_measurement(current, previous), **label)
