"""Sources: named tables, snapshots, CSV with a schema companion, Arrow files,
JSON payloads, any Spark source, lookups and baselines."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..plans.profile import PROFILE_SCHEMA

CORRUPT = "_corrupt_record"

# Catalog type names and the Spark types they are read as.
CATALOG_TYPES = {
    "NUMBER": "double",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP_NTZ": "timestamp_ntz",
    "DATE": "date",
    "VARIANT": "string",
    "JSON": "string",
}


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A table by its 1-, 2- or 3-part name."""
    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(parts):
        raise ValueError(f"table names have one to three parts: {name!r}")
    return spark.table(name)


def _snapshots(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{dataset}").parquet(f"{root}/{dataset}")


def _newest_dates(df: DataFrame, n: int) -> list[Any]:
    """Newest snapshot dates. Only the partition column is touched, so Spark
    answers from directory names; as many values as there are snapshots."""
    dates = df.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(n)
    return [r.snapshot_date for r in dates.collect()]


def scan_snapshot(
    spark: SparkSession, root: str, dataset: str, snapshot_date: Any = None
) -> DataFrame:
    """`root/dataset/snapshot_date=.../*.parquet`; the newest date by default.
    The filter is on the partition column, so other dates are never opened."""
    df = _snapshots(spark, root, dataset)
    if snapshot_date is None:
        newest = _newest_dates(df, 1)
        if not newest:
            raise ValueError(f"no snapshot of {dataset}")
        snapshot_date = newest[0]
    return df.filter(F.col("snapshot_date") == F.lit(snapshot_date)).drop("snapshot_date")


def snapshot_pair(spark: SparkSession, root: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """The current and the previous snapshot."""
    dates = _newest_dates(_snapshots(spark, root, dataset), 2)
    if len(dates) < 2:
        raise ValueError(f"{dataset} has no previous snapshot")
    return scan_snapshot(spark, root, dataset, dates[0]), scan_snapshot(spark, root, dataset, dates[1])


def companion_schema(companion: Mapping[str, Any]) -> T.StructType:
    """Spark schema of a companion `{"columns": [{"name", "type", "nullable"}]}`.
    CSV cannot enforce nullability, so every field is read as nullable and the
    declared value is kept in the field's metadata for contract checks."""
    fields = []
    for c in companion["columns"]:
        name = CATALOG_TYPES.get(str(c["type"]).upper(), str(c["type"]).lower())
        data_type = T.StructType.fromDDL(f"x {name}")[0].dataType
        fields.append(
            T.StructField(c["name"], data_type, True, {"declared_nullable": bool(c.get("nullable", True))})
        )
    return T.StructType(fields)


def load_companion(spark: SparkSession, path: str) -> dict[str, Any]:
    """Schema companion file, JSON or (where a YAML reader is installed) YAML.
    A companion is a few lines of text."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading a YAML companion needs the yaml module") from e
        return yaml.safe_load(text)
    return json.loads(text)


def scan_csv(
    spark: SparkSession,
    path: str,
    companion: Mapping[str, Any] | str,
    header: bool = True,
    **options: Any,
) -> DataFrame:
    """Rows that do not fit the schema stay, with their text in _corrupt_record."""
    if isinstance(companion, str):
        companion = load_companion(spark, companion)
    schema = companion_schema(companion).add(CORRUPT, T.StringType())
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .options(**options)
        .csv(path)
    )


def csv_rejects(spark: SparkSession, path: str, companion: Mapping[str, Any], **options: Any) -> DataFrame:
    """Number of rows read and rejected, and a hash of what was read. All columns
    take part, because Spark only parses (and so only rejects) the columns a
    query needs."""
    df = scan_csv(spark, path, companion, **options)
    touched = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != CORRUPT])
    return df.select(F.col(CORRUPT), touched.alias("_h")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(CORRUPT).alias("rejected_rows"),
        F.bit_xor("_h").alias("content_hash"),
    )


# Of an Arrow file that one task reads, about.
SPAN_BYTES = 128 << 20


def _arrow_file(uri: str) -> Any:
    """An open file behind any path that Arrow's filesystem layer knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    filesystem, where = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(where)


def arrow_spans(listed: DataFrame, span_bytes: int) -> DataFrame:
    """(path, first, last): ranges of record batches, about `span_bytes` each, from the
    files' footers. `listed`: path and length."""

    def spans(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple[str, int, int]] = []
            for uri, length in zip(*(batch.column(i).to_pylist() for i in range(2))):
                with _arrow_file(uri) as source:
                    n = pa.ipc.open_file(source).num_record_batches
                each = max(1, n * span_bytes // max(1, length))
                rows += [(uri, i, min(i + each, n)) for i in range(0, n, each)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["path", "first", "last"],
            )

    return listed.mapInArrow(spans, "path string, first bigint, last bigint")


def scan_arrow(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | T.StructType,
    span_bytes: int = SPAN_BYTES,
) -> DataFrame:
    """Arrow IPC / Feather files, read inside tasks, batch by batch.

    Only file names and ranges of record batches travel through Spark: a first step
    reads the footers, and large files are then shared by as many tasks as their size
    asks for. Each task opens its files through Arrow's filesystem layer and yields
    record batches, so no file is held whole.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in fields.fields]
    listed = (
        spark.read.format("binaryFile")
        .load(list(paths) if not isinstance(paths, str) else paths)
        .select("path", "length")
    )
    size = listed.agg(F.sum("length").alias("n")).first().n or 0
    tasks = size // span_bytes + 1

    def read(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in batches:
            for uri, first, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with _arrow_file(uri) as source:
                    reader = pa.ipc.open_file(source)
                    for i in range(first, last):
                        yield reader.get_batch(i).select(names)

    return arrow_spans(listed, span_bytes).repartition(int(tasks)).mapInArrow(read, fields)


def scan_payload(
    spark: SparkSession, path: str, column: str = "payload", fmt: str = "text"
) -> DataFrame:
    """A table with one JSON payload column: lines of text, or a Parquet column."""
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", column)
    return spark.read.format(fmt).load(path).select(column)


# Options that cut a JDBC read into tasks; Spark needs all four.
JDBC_CUT = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def scan_source(
    spark: SparkSession, fmt: str, options: Mapping[str, Any], path: str | None = None, one_task: bool = False
) -> DataFrame:
    """Any Spark source, JDBC included (filters and columns are pushed down).

    A JDBC table without partition options would be read by a single task; that is
    refused unless `one_task` says that the table is small."""
    given = {k.lower() for k in options}
    missing = [k for k in JDBC_CUT if k.lower() not in given]
    if fmt.lower() == "jdbc" and missing and not one_task:
        raise ValueError(f"a JDBC read needs {', '.join(missing)}, or one_task=True for a small table")
    return spark.read.format(fmt).options(**options).load(path)


def load_lookup(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Allowed values from CSV (first column, or the named one) or JSON lines."""
    if path.endswith(".json"):
        df = spark.read.json(path)
    else:
        df = spark.read.option("header", True).csv(path)
    name = column or df.columns[0]
    return df.select(F.col(name).alias("value")).filter(F.col("value").isNotNull()).distinct()


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).json(path)
