"""Declarations: what to check, on which rows, and how strictly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

SEVERITIES = ("blocker", "major", "minor")
GATES = ("fail", "warn")
STATUSES = ("pass", "fail", "error", "skip")

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("suite", T.StringType()),
        T.StructField("test", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("gate", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("violations", T.LongType()),
        T.StructField("observed", T.DoubleType()),
        T.StructField("expected", T.DoubleType()),
        T.StructField("tolerance", T.DoubleType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error_message", T.StringType()),
        T.StructField("as_of", T.TimestampNTZType()),
    ]
)


@dataclass(frozen=True)
class Tolerance:
    abs: float | None = None
    pct: float | None = None
    dup_rows: int | None = None
    hours: int | None = None


@dataclass(frozen=True)
class Window:
    """Rows a check looks at: a trailing period, one batch, or a half-open range."""

    last_days: int | None = None
    last_hours: int | None = None
    batch_id: Any = None
    start_date: Any = None
    end_date: Any = None


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Check:
    """One declared check. `params` holds what only some kinds need
    (parent table, JSON path, allowed values, ...)."""

    name: str
    type: str
    dataset: str
    keys: tuple[str, ...] = ()
    expression: str | None = None
    window: Window | None = None
    filters: tuple[Filter, ...] = ()
    tolerance: Tolerance = Tolerance()
    severity: str = "major"
    gate: str = "fail"
    enabled: bool = True
    tags: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}, not {self.severity!r}")
        if self.gate not in GATES:
            raise ValueError(f"gate must be one of {GATES}, not {self.gate!r}")
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "filters", tuple(self.filters))
        object.__setattr__(self, "tags", tuple(self.tags))


@dataclass(frozen=True)
class Suite:
    name: str
    tests: Sequence[Check]
    connection: str = "spark"
    description: str | None = None
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]

    @classmethod
    def of(cls, columns: Sequence[str], ref: str) -> "ForeignKey":
        """`ref` is written TABLE(COL, COL)."""
        table, _, cols = ref.partition("(")
        return cls(
            tuple(columns),
            table.strip(),
            tuple(c.strip() for c in cols.rstrip(") ").split(",") if c.strip()),
        )


@dataclass(frozen=True)
class DatasetMeta:
    """What a catalog knows about a dataset beyond its columns."""

    name: str
    kind: str = "table"
    row_count_estimate: int | None = None
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    watermark_column: str | None = None
    batch_column: str | None = None
    business_keys: tuple[str, ...] = ()
    lineage: tuple[str, ...] = ()
