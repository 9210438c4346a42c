"""Shared helpers: registration, intermediate tables, small expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a
    single-process session that sets none, a new temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tablecheck-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, codec: str = "zstd", release: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: the plan before it ends
    there, a lost executor costs nothing, and columns are read on demand. With
    `release`, the write's shuffle files go when it ends, not when the driver
    collects garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if release:
        before = spark.conf.get(SHUFFLE_CLEANUP)
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if release:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text (null and empty alike)."""
    t = F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(t, 256), 1, 32))


def rows_frame(spark: SparkSession, fields: str, rows: list[tuple]) -> DataFrame:
    """A few literal rows as a frame that plans on the JVM side. `fields`: DDL."""
    types = [part.strip().split(" ", 1) for part in fields.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in types])
    made = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, types)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))
