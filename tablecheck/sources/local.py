"""Small constant tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(
    spark: SparkSession, rows: Iterable[Sequence[Any]], schema: str | T.StructType
) -> DataFrame:
    """Rows known on the driver (rules, contracts, result rows) as a local
    relation. Unlike rows that go through an RDD it has a known size, so a join
    with it is planned as a broadcast without running anything first."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in fields.fields]
    table = pa.Table.from_pylist(
        [dict(zip(names, row)) for row in rows], schema=to_arrow_schema(fields)
    )
    return spark.createDataFrame(table, fields)
