"""Declarative transforms from payloads to tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import payloads as P
from ..functions.predicates import apply_filters, rule_predicate
from ..spec import Filter
from .payload import parsed_name, parsed_rows

Mapping_ = Mapping[str, tuple[str, str]]


@dataclass(frozen=True)
class TxSpec:
    """`mapping`: column -> (path, type) on the payload. With `explode`, one row
    per element of that array and `item_mapping` on the element. `filters` apply
    to the mapped columns. `rules`: name -> rule, checked per output row."""

    payload: str
    mapping: Mapping_
    explode: str | None = None
    item_mapping: Mapping_ = field(default_factory=dict)
    filters: Sequence[Filter] = ()
    rules: Mapping[str, str] = field(default_factory=dict)
    tolerance: float = 0.01
    keep: Sequence[str] = ()


def apply_txspec(df: DataFrame, spec: TxSpec) -> DataFrame:
    """The transformed table; with rules also `broken_rules`, the names of the
    rules a row breaks."""
    base = parsed_rows(df.select(*dict.fromkeys([*spec.keep, spec.payload])), spec.payload)
    v = F.col(parsed_name(spec.payload))
    columns = [*spec.keep, *[P.at_as(v, p, t).alias(c) for c, (p, t) in spec.mapping.items()]]
    if spec.explode is None:
        out = base.select(*columns)
    else:
        out = base.select(*columns, F.explode(P.items(v, spec.explode)).alias("_item")).select(
            *spec.keep,
            *spec.mapping,
            *[P.at_as(F.col("_item"), p, t).alias(c) for c, (p, t) in spec.item_mapping.items()],
        )
    out = apply_filters(out, spec.filters)
    if not spec.rules:
        return out
    broken = [
        F.when(F.coalesce(rule_predicate(out, r, spec.tolerance), F.lit(False)), F.lit(name))
        for name, r in spec.rules.items()
    ]
    return out.withColumn("broken_rules", F.filter(F.array(*broken), lambda x: x.isNotNull()))
