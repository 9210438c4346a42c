"""Runs registered queries next to DuckDB and reports differences."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from typing import Any

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablecheck-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v: Any) -> Any:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else f
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def family(name: str) -> str:
    n = name.lower()
    if n.startswith(("bigint", "int", "smallint", "tinyint", "hugeint", "ubigint", "long")):
        return "int"
    if n.startswith(("double", "float", "decimal")):
        return "float"
    if n.startswith("timestamp"):
        return "timestamp"
    if n.startswith(("varchar", "string")):
        return "string"
    return n.split("(")[0]


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, fn: Any, sql: str | None):
    """(problem or None, rows, seconds)"""
    started = time.time()
    df = fn(spark, folder)
    rows = df.collect()
    took = time.time() - started
    if sql is None:
        return None, len(rows), took
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} != {sorted(rel.columns)}", len(rows), took
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema.fields:
        a, b = family(f.dataType.simpleString()), family(types[f.name])
        if a != b:
            return f"type of {f.name}: {f.dataType.simpleString()} != {types[f.name]}", len(rows), took
    pos = {c: i for i, c in enumerate(rel.columns)}
    ours = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[pos[c]]) for c in names) for r in rel.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}", len(rows), took
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{names}: {a} != {b}", len(rows), took
    return None, len(rows), took


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = session(), connect(folder)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, n, took = compare(spark, con, folder, fn, entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            problem, n, took = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        kind = "" if name in entry.oracle_sql() else " (no SQL)"
        print(f"{'ok ' if problem is None else 'BAD'} {name}{kind} rows={n} {took:.2f}s {problem or ''}", flush=True)
        bad += problem is not None
    print("bad:", bad)
