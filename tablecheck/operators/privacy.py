"""Finding, hiding and reporting personal data in tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import privacy as P
from ..verdict import Judgement, Measurement, result, zero
from .aggregates import rows


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def pii_columns(df: DataFrame) -> DataFrame:
    """Columns whose name suggests personal data: (column, type)."""
    from ..plans.catalog import table_schema

    return table_schema(df).filter(P.is_pii_name(F.col("column"))).select("column", "type")


_TELLING = re.compile("|".join(f"(?:{p})" for p in P.NAME_PATTERNS), re.IGNORECASE)


def named_pii(df: DataFrame) -> list[str]:
    """The same names as a list, from metadata alone."""
    return [c for c in df.columns if _TELLING.search(c)]


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_TELLING.search(f.name) or _holds_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.valueType)
    return isinstance(kind, T.StringType)


def _redacted(c: Column, name: str, kind: T.DataType, strategy: str) -> Column:
    if _TELLING.search(name):
        return P.hide(c.cast("string"), strategy)
    if not _holds_text(kind):
        return c
    if isinstance(kind, T.StructType):
        fields = [_redacted(c.getField(f.name), f.name, f.dataType, strategy).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _redacted(x, "", kind.elementType, strategy))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: _redacted(v, "", kind.valueType, strategy))
    return P.redact_values(c)


def redact(df: DataFrame, strategy: str = "mask") -> DataFrame:
    """Columns and struct fields with a telling name are hidden by `strategy` whatever
    their type; other text, also inside structs, arrays and map values, has matching
    values replaced; everything else, map keys included, stays."""
    return df.select(
        *[_redacted(F.col(f.name), f.name, f.dataType, strategy).alias(f.name) for f in df.schema.fields]
    )


def pii_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Matches and affected rows per text column and pattern, in one pass."""
    columns = list(columns or string_columns(df))
    guarded = df.select(
        *columns,
        *[P.may_have_email(F.col(c)).alias(f"_e{i}") for i, c in enumerate(columns)],
        *[P.may_have_number(F.col(c)).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    counted = guarded.select(
        *[
            P.count_matches(F.col(c), kind, F.col(f"_{'e' if kind == 'email' else 'n'}{i}")).alias(
                f"c{i}_{kind}"
            )
            for i, c in enumerate(columns)
            for kind in P.VALUE_PATTERNS
        ]
    )
    aggregates, lines = [], []
    for i, c in enumerate(columns):
        for kind in P.VALUE_PATTERNS:
            n = F.col(f"c{i}_{kind}")
            aggregates += [
                F.coalesce(F.sum(n), F.lit(0)).alias(f"m{i}_{kind}"),
                F.count_if(n > 0).alias(f"r{i}_{kind}"),
            ]
            lines.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(kind).alias("kind"),
                    F.col(f"m{i}_{kind}").cast("bigint").alias("matches"),
                    F.col(f"r{i}_{kind}").alias("rows_affected"),
                )
            )
    return counted.agg(*aggregates).select(F.inline(F.array(*lines)))


def pii_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cond = F.lit(False)
    for c in columns or string_columns(df):
        cond = cond | P.has_match(F.col(c))
    return df.filter(cond)


def no_pii_measurement(
    output: DataFrame, source: DataFrame | None = None, values: bool = False
) -> Measurement:
    """Columns of `output` whose name suggests personal data, and whether it
    carries every column of `source`. That much is metadata. With `values`, rows
    whose text matches a pattern of personal data are violations too."""
    exposed = named_pii(output)
    everything = source is not None and set(source.columns) <= set(output.columns)
    n = len(exposed) + (1 if everything and exposed else 0)
    found = F.lit(False)
    for c in string_columns(output) if values else ():
        found = found | F.coalesce(P.has_match(F.col(c)), F.lit(False))

    def judge(m: Any) -> Judgement:
        violations = F.lit(n) + m("matching")
        matching = {"matching_rows": m("matching")} if values else {}
        return Judgement(
            violations=violations,
            passed=zero(violations),
            observed=violations,
            expected=F.lit(0),
            metrics={
                "exposed_columns": F.lit(",".join(exposed)),
                "all_columns": F.lit(str(everything).lower()),
                "total_rows": m("rows"),
                **matching,
            },
        )

    return Measurement(output, {"rows": rows(), "matching": F.count_if(found)}, judge)


def check_no_pii(
    output: DataFrame, source: DataFrame | None = None, values: bool = False, **label: Any
) -> DataFrame:
    return result("no_pii", no_pii_measurement(output, source, values), **{"gate": "warn", **label})
