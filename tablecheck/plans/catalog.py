"""Catalogs as DataFrames.

`datasets`: dataset, kind, row_count_estimate, primary_key, foreign_keys,
watermark_column, lineage.  `columns`: dataset, column, type, nullable,
description.  Imports are Spark JSON reads, so a folder with thousands of packages
is read in parallel like any other source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.local import local_frame
from ..spec import DatasetMeta, ForeignKey

COLUMNS_SCHEMA = "dataset string, column string, type string, nullable boolean, description string"
DATASETS_SCHEMA = (
    "dataset string, kind string, row_count_estimate bigint, primary_key array<string>, "
    "foreign_keys array<struct<columns:array<string>,ref_table:string,ref_columns:array<string>>>, "
    "watermark_column string, lineage array<string>"
)

_PACKAGE_SCHEMA = (
    "version string, generated_at string, environment string, datasets array<struct<"
    "name:string,kind:string,row_count_estimate:bigint,"
    "columns:array<struct<name:string,type:string,nullable:boolean,description:string>>,"
    "primary_key:array<string>,"
    "foreign_keys:array<struct<columns:array<string>,ref:string>>,"
    "watermark_column:string,lineage:array<string>>>, signatures map<string,string>"
)
_MANIFEST_SCHEMA = (
    "nodes map<string,struct<resource_type:string,name:string,"
    "columns:map<string,struct<data_type:string,description:string>>,"
    "depends_on:struct<nodes:array<string>>>>"
)
_DBT_CATALOG_SCHEMA = (
    "nodes map<string,struct<metadata:struct<name:string,type:string>,"
    "stats:struct<row_count:struct<value:double>>,"
    "columns:map<string,struct<type:string,comment:string>>>>"
)


@dataclass(frozen=True)
class Catalog:
    datasets: DataFrame
    columns: DataFrame


# ------------------------------------------------------------- schema frames


def table_schema(df: DataFrame) -> DataFrame:
    """Name, type, nullable, default and comment per column. Metadata only."""
    rows = [
        (
            i,
            f.name,
            f.dataType.simpleString(),
            f.nullable,
            (f.metadata or {}).get("CURRENT_DEFAULT"),
            (f.metadata or {}).get("comment"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return local_frame(
        df.sparkSession,
        rows,
        "position int, column string, type string, nullable boolean, default string, description string",
    )


def contract_frame(
    spark: SparkSession, contract: DataFrame | Sequence[tuple[str, str, bool | None]]
) -> DataFrame:
    if isinstance(contract, DataFrame):
        return contract
    return local_frame(
        spark, [tuple(c) for c in contract], "column string, type string, nullable boolean"
    )


# -------------------------------------------------------------------- imports


def _columns_of(exploded: DataFrame, col: str) -> DataFrame:
    return exploded.select("dataset", F.explode(col).alias("c")).select(
        "dataset",
        F.col("c.name").alias("column"),
        F.col("c.type").alias("type"),
        F.coalesce("c.nullable", F.lit(True)).alias("nullable"),
        F.col("c.description").alias("description"),
    )


def catalog_from_package(spark: SparkSession, path: str) -> Catalog:
    raw = spark.read.schema(_PACKAGE_SCHEMA).json(path, multiLine=True)
    d = raw.select(F.explode("datasets").alias("d")).select(F.col("d.name").alias("dataset"), "d.*")
    fks = F.transform(
        "foreign_keys",
        lambda k: F.struct(
            k["columns"].alias("columns"),
            F.trim(F.substring_index(k["ref"], "(", 1)).alias("ref_table"),
            F.transform(
                F.split(F.regexp_extract(k["ref"], r"\((.*)\)", 1), ","), lambda c: F.trim(c)
            ).alias("ref_columns"),
        ),
    )
    none = F.array().cast("array<string>")
    datasets = d.select(
        "dataset",
        "kind",
        "row_count_estimate",
        F.coalesce("primary_key", none).alias("primary_key"),
        F.coalesce(fks, F.array()).alias("foreign_keys"),
        "watermark_column",
        F.coalesce("lineage", none).alias("lineage"),
    )
    return Catalog(datasets, _columns_of(d, "columns"))


def _without_keys(spark_columns: list) -> list:
    return [
        *spark_columns,
        F.array().cast("array<string>").alias("primary_key"),
        F.from_json(
            F.lit("[]"),
            "array<struct<columns:array<string>,ref_table:string,ref_columns:array<string>>>",
        ).alias("foreign_keys"),
        F.lit(None).cast("string").alias("watermark_column"),
    ]


def catalog_from_dbt_manifest(spark: SparkSession, path: str) -> Catalog:
    """Models only; a column without a type is STRING; lineage from depends_on."""
    raw = spark.read.schema(_MANIFEST_SCHEMA).json(path, multiLine=True)
    d = (
        raw.select(F.explode("nodes").alias("id", "n"))
        .filter(F.col("n.resource_type") == "model")
        .select(F.col("n.name").alias("dataset"), "n.*")
    )
    datasets = d.select(
        *_without_keys(
            ["dataset", F.lit("view").alias("kind"), F.lit(None).cast("bigint").alias("row_count_estimate")]
        ),
        F.coalesce("depends_on.nodes", F.array().cast("array<string>")).alias("lineage"),
    )
    columns = d.select("dataset", F.explode("columns").alias("column", "c")).select(
        "dataset",
        "column",
        F.coalesce("c.data_type", F.lit("STRING")).alias("type"),
        F.lit(True).alias("nullable"),
        F.col("c.description").alias("description"),
    )
    return Catalog(datasets, columns)


def catalog_from_dbt_catalog(spark: SparkSession, path: str) -> Catalog:
    """All nodes; name and kind from their metadata, row estimate from stats."""
    raw = spark.read.schema(_DBT_CATALOG_SCHEMA).json(path, multiLine=True)
    d = raw.select(F.explode("nodes").alias("id", "n")).select(
        F.col("n.metadata.name").alias("dataset"), "n.*"
    )
    datasets = d.select(
        *_without_keys(
            [
                "dataset",
                F.coalesce("metadata.type", F.lit("table")).alias("kind"),
                F.col("stats.row_count.value").cast("bigint").alias("row_count_estimate"),
            ]
        ),
        F.array().cast("array<string>").alias("lineage"),
    )
    columns = d.select("dataset", F.explode("columns").alias("column", "c")).select(
        "dataset",
        "column",
        F.coalesce("c.type", F.lit("STRING")).alias("type"),
        F.lit(True).alias("nullable"),
        F.col("c.comment").alias("description"),
    )
    return Catalog(datasets, columns)


def catalog_from_tables(
    tables: Mapping[str, DataFrame], metas: Mapping[str, DatasetMeta] | None = None
) -> Catalog:
    """Introspect Spark tables; keys and lineage from `metas` where known."""
    spark = next(iter(tables.values())).sparkSession
    metas = metas or {}
    columns, datasets = [], []
    for name, df in tables.items():
        m = metas.get(name, DatasetMeta(name))
        columns += [
            (name, f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment"))
            for f in df.schema.fields
        ]
        datasets.append(
            (
                name,
                m.kind,
                m.row_count_estimate,
                list(m.primary_key),
                [(list(k.columns), k.ref_table, list(k.ref_columns)) for k in m.foreign_keys],
                m.watermark_column,
                list(m.lineage),
            )
        )
    return Catalog(
        local_frame(spark, datasets, DATASETS_SCHEMA),
        local_frame(spark, columns, COLUMNS_SCHEMA),
    )


def observed_columns(
    df: DataFrame, dataset: str | None, payload: str, name: str = "payload"
) -> DataFrame:
    """Columns of the datasets that share one payload table: the JSON keys seen
    per dataset with their type class; a key that some rows lack, or hold as
    JSON null, is nullable. One pass, reduced per (dataset, key, type) on the map
    side; rows without a readable object count as lacking every key. `dataset`
    is the column that tells datasets apart; None if all rows are one, `name`.
    """
    from ..functions import payloads as P
    from ..operators.payload import object_fields, parsed_name, with_parsed

    by = [] if dataset is None else ["dataset"]
    v = F.col(parsed_name(payload))
    lone = F.array(
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value"))
    )
    source = df.select(*[F.col(dataset).alias(b) for b in by], payload)
    counted = (
        with_parsed(source, payload)
        .select(*by, F.explode(F.coalesce(object_fields(v), lone)).alias("f"))
        .select(*by, F.col("f.key").alias("column"), P.type_class(F.col("f.value")).alias("type"))
        .groupBy(*by, "column", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    real = F.col("type") != "NULL"
    per_column = counted.groupBy(*by, "column").agg(
        F.max(F.when(real, F.col("type"))).alias("type"),
        F.count_if(real).alias("types"),
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("n"),
        F.count("column").alias("keyed"),
    )
    # The entry without a column holds the number of rows. Both aggregates read
    # the same counts, and the filter on a counted value stays above them, so
    # Spark counts once.
    all_rows = F.sum(F.when(F.col("column").isNull(), F.col("n"))).alias("total")
    if by:
        totals = counted.groupBy(F.col("dataset").alias("_d")).agg(all_rows)
        joined = per_column.join(totals, F.col("dataset").eqNullSafe(F.col("_d")))
    else:
        joined = per_column.withColumns(
            {"total": counted.agg(all_rows).scalar(), "dataset": F.lit(name)}
        )
    return joined.filter(F.col("keyed") > 0).select(
        "dataset",
        "column",
        F.when(F.col("types") > 1, "VARIANT").otherwise(F.col("type")).alias("type"),
        (F.col("n") < F.col("total")).alias("nullable"),
        F.lit(None).cast("string").alias("description"),
    )


def dataset_metas(catalog: Catalog) -> dict[str, DatasetMeta]:
    """Dataset records for the runner. A catalog has as many rows as there are
    tables, so this small read is the one place where it comes to the driver."""
    return {
        r.dataset: DatasetMeta(
            name=r.dataset,
            kind=r.kind,
            row_count_estimate=r.row_count_estimate,
            primary_key=tuple(r.primary_key),
            foreign_keys=tuple(
                ForeignKey(tuple(k.columns), k.ref_table, tuple(k.ref_columns)) for k in r.foreign_keys
            ),
            watermark_column=r.watermark_column,
            lineage=tuple(r.lineage),
        )
        for r in catalog.datasets.collect()
    }


# ----------------------------------------------------------- signatures, diffs


def dataset_signatures(columns: DataFrame) -> DataFrame:
    """SHA-256 over `name:type:nullable`, sorted by name, joined by `|`.

    One dataset's column list meets in one row: bounded by the width of a table,
    not by its rows (duplicates are removed before they are collected).
    """
    lines = F.array_sort(F.collect_list(F.struct("column", "type", "nullable")))
    text = F.transform(
        lines,
        lambda x: F.concat_ws(
            ":", x["column"], x["type"], F.when(x["nullable"], "True").otherwise("False")
        ),
    )
    return (
        columns.select("dataset", "column", "type", "nullable")
        .distinct()
        .groupBy("dataset")
        .agg(F.sha2(F.concat_ws("|", text), 256).alias("signature"))
    )


def catalog_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(dataset, change, column, from_type, to_type) between two column frames."""
    c = current.select("dataset", "column", "type", "nullable").alias("c")
    p = previous.select("dataset", "column", "type", "nullable").alias("p")
    cond = (F.col("c.dataset") == F.col("p.dataset")) & (F.col("c.column") == F.col("p.column"))
    has_c, has_p = F.col("c.column").isNotNull(), F.col("p.column").isNotNull()
    pairs = c.join(p, cond, "full_outer").select(
        F.coalesce("c.dataset", "p.dataset").alias("dataset"),
        F.coalesce("c.column", "p.column").alias("column"),
        has_c.alias("in_c"),
        has_p.alias("in_p"),
        F.col("p.type").alias("from_type"),
        F.col("c.type").alias("to_type"),
        F.col("p.nullable").alias("from_null"),
        F.col("c.nullable").alias("to_null"),
    )
    both = F.col("in_c") & F.col("in_p")
    sides = pairs.groupBy("dataset").agg(
        F.bool_or("in_c").alias("now"),
        F.bool_or("in_p").alias("before"),
        F.bool_or(
            ~both
            | (F.col("from_type") != F.col("to_type"))
            | (F.col("from_null") != F.col("to_null"))
        ).alias("differs"),
    )
    none = F.lit(None).cast("string")
    on_dataset = sides.select(
        "dataset",
        F.when(~F.col("before"), "dataset_added")
        .when(~F.col("now"), "dataset_removed")
        .when(F.col("differs"), "dataset_modified")
        .alias("change"),
        none.alias("column"),
        none.alias("from_type"),
        none.alias("to_type"),
    ).filter(F.col("change").isNotNull())

    def line(cond, name: str, a, b):
        return F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(F.lit(name).alias("change"), a.alias("from_type"), b.alias("to_type")),
        )

    details = F.filter(
        F.array(
            line(~F.col("in_p"), "column_added", none, F.col("to_type")),
            line(~F.col("in_c"), "column_removed", F.col("from_type"), none),
            line(both & (F.col("from_type") != F.col("to_type")), "type_changed", F.col("from_type"), F.col("to_type")),
            line(
                both & (F.col("from_null") != F.col("to_null")),
                "nullable_changed",
                F.col("from_null").cast("string"),
                F.col("to_null").cast("string"),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    kept = sides.filter(F.col("now") & F.col("before") & F.col("differs")).select("dataset")
    on_column = (
        pairs.join(kept, "dataset", "left_semi")
        .select("dataset", "column", F.explode(details).alias("d"))
        .select("dataset", F.col("d.change").alias("change"), "column", F.col("d.from_type").alias("from_type"), F.col("d.to_type").alias("to_type"))
    )
    return on_dataset.unionByName(on_column)


# --------------------------------------------------------------------- listing


def list_datasets(
    datasets: DataFrame,
    pattern: str | None = None,
    kind: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Name contains `pattern` (any case), kind equal; a page in name order."""
    if pattern:
        datasets = datasets.filter(F.contains(F.lower("dataset"), F.lit(pattern.lower())))
    if kind:
        datasets = datasets.filter(F.col("kind") == kind)
    return datasets.orderBy("dataset").offset(offset).limit(limit)


def list_catalogs(
    spark: SparkSession, path: str, environment: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Packages under a path: version, time, environment, number of datasets."""
    raw = spark.read.schema(_PACKAGE_SCHEMA).json(path, multiLine=True)
    if environment:
        raw = raw.filter(F.col("environment") == environment)
    return (
        raw.select(
            "version", "generated_at", "environment", F.size("datasets").alias("dataset_count")
        )
        .orderBy("generated_at", "version")
        .offset(offset)
        .limit(limit)
    )


def union_columns(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


