import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablecheck.sources import readers as R
from tablecheck.sources.writers import write_baseline


def test_snapshots(spark, frame, tmp_path):
    root = str(tmp_path)
    for day, n in (("2025-08-29", 1), ("2025-08-30", 2), ("2025-08-28", 3)):
        frame([(i,) for i in range(n)], "id int").write.parquet(f"{root}/RAW.ORDERS/snapshot_date={day}")
    assert R.scan_snapshot(spark, root, "RAW.ORDERS").count() == 2
    assert R.scan_snapshot(spark, root, "RAW.ORDERS", dt.date(2025, 8, 28)).count() == 3
    cur, prev = R.snapshot_pair(spark, root, "RAW.ORDERS")
    assert (cur.count(), prev.count(), cur.columns) == (2, 1, ["id"])
    plan = cur._jdf.queryExecution().executedPlan().toString()
    assert "snapshot_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_snapshot_pair_needs_two(spark, frame, tmp_path):
    frame([(1,)], "id int").write.parquet(f"{tmp_path}/T/snapshot_date=2025-01-01")
    with pytest.raises(ValueError):
        R.snapshot_pair(spark, str(tmp_path), "T")


def test_csv_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "o.csv").write_text("ORDER_ID,ORDER_TS,NOTE\n1,2024-01-01 00:00:00,a\nx,2024-01-01 00:00:00,b\n3,never,c\n")
    (tmp_path / "schema.json").write_text('{"dataset":"RAW.ORDERS","columns":[{"name":"ORDER_ID","type":"NUMBER","nullable":false},{"name":"ORDER_TS","type":"TIMESTAMP","nullable":false},{"name":"NOTE","type":"STRING"}]}')
    companion = R.load_companion(spark, str(tmp_path / "schema.json"))
    df = R.scan_csv(spark, str(tmp_path / "o.csv"), companion)
    rows = df.collect()
    assert len(rows) == 3 and sum(r._corrupt_record is not None for r in rows) == 2
    assert dict(df.dtypes)["ORDER_TS"] == "timestamp_ntz"
    assert df.schema["ORDER_ID"].metadata == {"declared_nullable": False}
    r = R.csv_rejects(spark, str(tmp_path / "o.csv"), companion).first()
    assert (r.total_rows, r.rejected_rows) == (3, 2)


def test_arrow(spark, tmp_path):
    for i in range(3):
        table = pa.table({"id": pa.array(range(i * 10, i * 10 + 10), pa.int64()), "s": [f"v{i}"] * 10})
        with pa.ipc.new_file(str(tmp_path / f"f{i}.arrow"), table.schema) as w:
            w.write_table(table, max_chunksize=4)
    df = R.scan_arrow(spark, str(tmp_path), "id bigint, s string")
    assert (df.count(), df.agg({"id": "sum"}).first()[0]) == (30, 435)
    assert R.scan_arrow(spark, [str(tmp_path / "f1.arrow")], "s string").distinct().first().s == "v1"


def test_one_arrow_file_is_read_by_several_tasks(spark, tmp_path):
    table = pa.table({"id": pa.array(range(4000), pa.int64()), "s": ["x" * 50] * 4000})
    empty = table.slice(0, 0)
    for name, rows in (("large", table), ("empty", empty)):
        with pa.ipc.new_file(str(tmp_path / f"{name}.arrow"), table.schema) as w:
            w.write_table(rows, max_chunksize=100)
    df = R.scan_arrow(spark, str(tmp_path), "s string, id bigint", span_bytes=40_000)
    by_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("id").alias("n")).collect()
    assert len(by_task) >= 4 and max(r.n for r in by_task) <= 1200
    assert sorted(r.id for r in df.collect()) == list(range(4000))
    (tmp_path / "none").mkdir()
    listed = spark.createDataFrame([], "path string, length bigint")
    assert R.arrow_spans(listed, 10).count() == 0


def test_payload_lookup_baseline_source(spark, frame, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"a":1}\n{"a":2}\n')
    assert R.scan_payload(spark, str(tmp_path / "p.jsonl")).columns == ["payload"]
    frame([('{"a":1}', 1)], "payload string, x int").write.parquet(str(tmp_path / "pq"))
    assert R.scan_payload(spark, str(tmp_path / "pq"), fmt="parquet").columns == ["payload"]
    (tmp_path / "l.csv").write_text("status,label\nF,x\nO,y\nF,z\n")
    assert sorted(r.value for r in R.load_lookup(spark, str(tmp_path / "l.csv")).collect()) == ["F", "O"]
    (tmp_path / "l.json").write_text('{"code":"A"}\n{"code":null}\n')
    assert [r.value for r in R.load_lookup(spark, str(tmp_path / "l.json"), "code").collect()] == ["A"]
    from tablecheck.plans.profile import profile

    p = profile(frame([(1,), (2,)], "v int"), "d", exact_distinct=True)
    write_baseline(p, str(tmp_path / "base"))
    again = R.load_baseline(spark, str(tmp_path / "base"))
    assert again.columns == p.columns and again.first().distinct_count == 2
    assert R.scan_source(spark, "csv", {"header": "true"}, str(tmp_path / "l.csv")).count() == 3


def test_tables_by_name(spark, frame):
    frame([(1,)], "id int").createOrReplaceTempView("some_view")
    assert R.scan_table(spark, "some_view").count() == 1
    for bad in ("", "a.b.c.d", "a..b"):
        with pytest.raises(ValueError):
            R.scan_table(spark, bad)


def test_schema_and_stats(spark, frame):
    from tablecheck.plans.catalog import table_schema
    from tablecheck.plans.profile import last_updated, table_stats

    df = frame([(1, dt.datetime(2024, 1, 1))], "id int, ts timestamp_ntz")
    assert [(r.column, r.type, r.nullable) for r in table_schema(df).orderBy("position").collect()] == [("id", "int", True), ("ts", "timestamp_ntz", True)]
    assert table_stats(df).first().row_count == 1
    assert last_updated(df, "ts").first().last_updated == dt.datetime(2024, 1, 1)


def test_unpartitioned_jdbc_is_refused(spark):
    with pytest.raises(ValueError, match="numPartitions"):
        R.scan_source(spark, "jdbc", {"url": "jdbc:x:y", "dbtable": "t", "partitionColumn": "id"})
