import datetime as dt

import pytest
from single_row import result_of
from pyspark.sql import functions as F

from tablecheck.functions.predicates import Filter as Flt, apply_filters, scope, window_last, window_range
from tablecheck.plans import budget, history as H, suite as S
from tablecheck.plans.registry import kinds, register_check
from tablecheck.spec import Check, DatasetMeta, Filter, ForeignKey, Suite, Tolerance, Window

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture
def tables(frame):
    orders = frame(
        [(1, 10, 5.0, dt.datetime(2024, 1, 30)), (2, None, -1.0, dt.datetime(2024, 1, 1)), (2, 10, 3.0, None)],
        "id int, cust int, total double, ts timestamp_ntz",
    )
    people = frame([(10, "Johnathan", "x@y.com")], "id int, name string, note string")
    return {"orders": orders, "people": people}


def by_name(df):
    return {r.test: r for r in df.collect()}


def test_mixed_suite(spark, tables):
    suite = Suite(
        "s",
        [
            Check("u", "uniqueness", "orders", keys=["id"]),
            Check("n", "not_null", "orders", keys=["cust"], gate="warn"),
            Check("fk", "reconciliation", "orders"),
            Check("f", "freshness", "orders"),
            Check("r", "rule", "orders", expression="total > 0", filters=[Filter("id", "equals", 1)]),
            Check("w", "row_count", "orders", window=Window(last_days=7), params={"min": 1, "max": 1}),
            Check("est", "row_count", "orders", tolerance=Tolerance(pct=1.0)),
            Check("bad", "rule", "orders", expression="nothing == 1"),
            Check("kind", "no_such_kind", "orders"),
            Check("table", "not_null", "missing", keys=["x"]),
            Check("off", "not_null", "orders", keys=["id"], enabled=False),
        ],
    )
    metas = {
        "orders": DatasetMeta(
            "orders",
            watermark_column="ts",
            row_count_estimate=3,
            foreign_keys=(ForeignKey.of(["cust"], "people(id)"),),
        )
    }
    got = by_name(S.run_suite(spark, suite, tables, AS_OF, "r1", metas))
    want = {
        "u": "fail", "n": "fail", "fk": "pass", "f": "pass", "r": "pass", "w": "pass", "est": "pass",
        "bad": "error", "kind": "error", "table": "error", "off": "skip",
    }
    assert {k: r.status for k, r in got.items()} == want
    assert got["kind"].error_message == "Unsupported test type: no_such_kind"
    assert "nothing" in got["bad"].error_message
    assert {r.run_id for r in got.values()} == {"r1"}
    assert {r.as_of for r in got.values()} == {dt.datetime(2024, 1, 31)}
    single = by_name(S.run_suite(spark, suite, tables, AS_OF, "r1", metas, fuse=False))
    assert single == got


def test_selected_names_leave_skip_rows(spark, tables):
    suite = Suite("s", [Check("a", "not_null", "orders", keys=["id"]), Check("b", "not_null", "orders", keys=["cust"])])
    got = by_name(S.run_suite(spark, suite, tables, AS_OF, names=["a"]))
    assert (got["a"].status, got["b"].status) == ("pass", "skip")


def test_aggregate_checks_share_one_scan(spark, tables):
    suite = Suite("s", [Check(f"c{i}", "rule", "orders", expression=f"total > {i}") for i in range(8)])
    plan = S.run_suite(spark, suite, tables, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_filters_and_windows_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    suite = Suite(
        "s",
        [
            Check("a", "rule", "orders", expression="o_totalprice > 0", filters=[Filter("o_orderstatus", "equals", "F")],
                  window=Window(start_date="1996-01-01", end_date="1997-01-01"), params={"watermark": "o_orderdate"}),
        ],
    )
    plan = S.run_suite(spark, suite, {"orders": orders}, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_trailing_window_is_pushed_down(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = window_last(events, "ts", days=7, as_of=AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in plan and "LessThanOrEqual(ts,2024-01-31T00:00)" in plan


def test_runtime_error_hits_only_its_check(spark, tables):
    suite = Suite(
        "s",
        [
            Check("ok", "rule", "people", expression="id > 0"),
            Check("boom", "invariant", "people", expression="cast(name as int) > 0"),
            Check("ok2", "not_null", "people", keys=["name"]),
        ],
    )
    got = by_name(S.execute_suite(spark, suite, tables, AS_OF))
    assert (got["ok"].status, got["boom"].status, got["ok2"].status) == ("pass", "error", "pass")
    assert "CAST_INVALID_INPUT" in got["boom"].error_message


def test_time_budget_runs_blockers_first(spark, tables):
    suite = Suite(
        "s",
        [
            Check("minor", "uniqueness", "orders", keys=["cust"], severity="minor"),
            Check("blocker", "uniqueness", "orders", keys=["id"], severity="blocker"),
        ],
    )
    unfinished = S.execute_suite(spark, suite, tables, AS_OF, budget_seconds=0)
    assert S.gate(unfinished).first().verdict in ("incomplete", "fail")
    got = by_name(unfinished)
    assert {r.status for r in got.values()} == {"skip"}
    got = by_name(S.execute_suite(spark, suite, tables, AS_OF, budget_seconds=600))
    assert {r.status for r in got.values()} == {"fail"}
    assert all(r.duration_ms >= 0 for r in got.values())


def test_dry_run(spark, tables):
    suite = Suite("s", [Check("a", "rule", "orders", expression="total > 0"), Check("b", "rule", "orders", expression="x > 0")])
    got = by_name(S.validate_suite(spark, suite, tables, AS_OF))
    assert (got["a"].valid, got["b"].valid) == (True, False)


def test_samples_are_masked_limited_and_only_for_failures(spark, tables, frame):
    many = frame([(i, "Johnathan", "call 555-123-4567 now") for i in range(150)], "id int, name string, note string")
    suite = Suite(
        "s",
        [
            Check("fails", "invariant", "many", expression="id < 10"),
            Check("passes", "invariant", "many", expression="id >= 0"),
        ],
    )
    t = {"many": many}
    results = S.run_suite(spark, suite, t, AS_OF)
    assert by_name(results)["fails"].violations == 140
    rows = S.sample_violations(spark, suite, results, t, as_of=AS_OF).collect()
    assert len(rows) == 100 and {r._test for r in rows} == {"fails"}
    assert '"name":"Joh***han","note":"call [REDACTED_PHONE] now"' in rows[0].row


def test_gate_and_summary(spark, tables):
    def verdict(checks):
        return S.gate(S.run_suite(spark, Suite("s", checks), tables, AS_OF, "r")).first()

    bad = dict(type="not_null", dataset="orders", keys=["cust"])
    good = Check("g", "not_null", "orders", keys=["id"])
    assert verdict([good]).verdict == "pass" and verdict([good]).worst is None
    assert verdict([good, Check("w", gate="warn", **bad)]).verdict == "warn"
    v = verdict([good, Check("w", gate="warn", **bad), Check("f", severity="blocker", **bad)])
    assert (v.verdict, v.failures, v.warnings, v.worst) == ("fail", 1, 1, "blocker")
    assert verdict([good, Check("off", enabled=False, **bad)]).verdict == "pass"
    s = S.run_summary(
        S.run_suite(spark, Suite("s", [good, Check("f", **bad), Check("e", "zzz", "orders")]), tables, AS_OF, "r"),
        "2024-01-31 00:00:00", "2024-01-31 00:00:02.25",
    ).first()
    assert (s.total_tests, s.passed_tests, s.failed_tests, s.error_tests, s.execution_time_ms) == (3, 1, 1, 1, 2250)
    assert s.status == "completed"


def test_register_check(spark, tables):
    register_check("positive_total", lambda df, c, env: F.col("total") <= 0)
    register_check("listed_people", lambda df, c, env: df.filter("id = 10"))
    suite = Suite("s", [Check("p", "positive_total", "orders"), Check("l", "listed_people", "people"), Check("r", "rule", "orders", expression="id > 0")])
    out = S.run_suite(spark, suite, tables, AS_OF)
    got = by_name(out)
    assert (got["p"].violations, got["l"].violations) == (1, 1)
    plan = S.run_suite(spark, Suite("s", [suite.tests[0], suite.tests[2]]), tables, AS_OF)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert {"uniqueness", "not_null", "freshness", "row_count", "reconciliation", "rule", "schema", "drift"} <= set(kinds())


def test_reconciliation_schema_drift_kinds(spark, tables, frame):
    t = dict(tables)
    t["orders2"] = tables["orders"].filter("id = 2")
    t["prev_schema"] = frame([("orders", "id", "string", True)], "dataset string, column string, type string, nullable boolean")
    suite = Suite(
        "s",
        [
            Check("agg", "reconciliation", "orders", params={"source": "orders2", "metrics": {"t": ("sum", "total")}}),
            Check("cnt", "reconciliation", "orders", params={"source": "orders2"}, tolerance=Tolerance(abs=1)),
            Check("cov", "reconciliation", "orders", params={"dimensions": [(["cust"], "people", ["id"])]}),
            Check("schema", "schema", "orders", params={"contract": [("id", "NUMBER", None), ("nope", "STRING", None)], "allow_extra": True}),
            Check("drift", "drift", "orders", params={"baseline": "orders2", "column": "id"}),
            Check("snap", "drift", "orders", keys=["id", "total"], params={"previous": "orders2"}),
            Check("sdrift", "drift", "orders", params={"previous_schema": "prev_schema"}),
        ],
    )
    got = by_name(S.run_suite(spark, suite, t, AS_OF))
    assert got["agg"].status == "fail"
    assert got["cnt"].status == "pass"
    assert (got["cov"].violations, got["schema"].violations) == (1, 1)
    assert got["drift"].status == "fail"
    assert (got["snap"].violations, got["snap"].metrics["added"]) == (1, "1")
    assert got["sdrift"].violations == 4


@pytest.mark.parametrize(
    "op, value, ids",
    [
        ("equals", 2, [2]), ("not_equals", 2, [1, 3]), ("in", [1, 3], [1, 3]), ("not_in", [1], [2, 3]),
        ("gt", 2, [3]), ("lt", 2, [1]), ("gte", 2, [2, 3]), ("lte", 2, [1, 2]),
    ],
)
def test_filters_drop_nulls(frame, op, value, ids):
    df = frame([(1,), (2,), (3,), (None,)], "id int")
    assert sorted(r.id for r in apply_filters(df, [Flt("id", op, value)]).collect()) == ids


def test_windows(frame):
    df = frame([(dt.datetime(2024, 1, d),) for d in (1, 24, 31)] + [(None,)], "ts timestamp_ntz")
    assert window_last(df, "ts", days=7, as_of=AS_OF).count() == 2
    assert window_range(df, "ts", "2024-01-01", "2024-01-24").count() == 1
    with pytest.raises(ValueError):
        window_last(df, "ts", days=400)
    with pytest.raises(ValueError):
        window_last(df, "ts")


def test_scope():
    tests = [Check("a", "not_null", "RAW.ORDERS", tags=["x"]), Check("b", "not_null", "DIM.CUSTOMER"), Check("c", "not_null", "stage.o")]
    assert [t.name for t in scope(tests, layer="raw")] == ["a"]
    assert [t.name for t in scope(tests, pattern="ORD|CUS")] == ["a", "b"]
    assert [t.name for t in scope(tests, tags=["x"])] == ["a"]
    assert [t.name for t in scope(tests, layer="PREP", names=["c"])] == ["c"]


def test_history_round_trip(spark, tables, tmp_path):
    from tablecheck.sources.writers import append_history, write_results, write_samples

    suite = Suite("s", [Check("n", "not_null", "orders", keys=["cust"])])
    path = str(tmp_path / "history")
    for i, day in enumerate(("2023-01-01 10:00:00", "2024-01-30 10:00:00")):
        append_history(S.run_suite(spark, suite, tables, day, f"run-{i}"), path)
    history = spark.read.parquet(path)
    assert H.run_results(history, "run-1").count() == 1
    assert [r.change for r in H.trend(history).orderBy("run_at").collect()] == [None, 0.0]
    assert H.retain(history, 90, AS_OF).count() == 1
    assert "run_date" in H.retain(history, 90, AS_OF)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert H.purge_history(spark, path, 90, AS_OF) == 1
    assert spark.read.parquet(path).count() == 1
    write_results(S.run_suite(spark, suite, tables, AS_OF, "r"), str(tmp_path / "results"))
    line = spark.read.json(str(tmp_path / "results")).first()
    assert (line.test, line.status, line.violations) == ("n", "fail", 1)
    results = S.run_suite(spark, suite, tables, AS_OF, "r")
    write_samples(S.sample_violations(spark, suite, results, tables), str(tmp_path / "samples"))
    assert spark.read.json(str(tmp_path / "samples")).filter("_test = 'n'").count() == 1


def test_budget_and_preview(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    suite = Suite("s", [Check("a", "not_null", "orders", keys=["o_orderkey"], severity="minor"), Check("b", "not_null", "orders", keys=["o_custkey"], severity="blocker")])
    plan = budget.plan_preview(spark, suite, {"orders": orders})
    size = plan.first().scan_bytes
    assert size > 1000
    got = by_name(budget.check_budget(plan, scan_bytes=int(size * 1.5)))
    assert (got["b"].keep, got["a"].keep) == (True, False)
    assert 0.4 < got["a"].sample_fraction < 0.6
    got = by_name(budget.check_budget(plan.withColumn("seconds", F.lit(10.0)), seconds=10))
    assert (got["b"].keep, got["a"].keep, got["a"].sample_fraction) == (True, False, 0.0)


def test_auto_sample(spark):
    df = spark.range(100_000)
    assert budget.auto_sample(df, 100_000) is df
    one = budget.auto_sample(df, 100_000, 10_000, by=["id"])
    n = one.count()
    assert 9_000 < n < 11_000
    again = budget.auto_sample(df.repartition(7), 100_000, 10_000, by=["id"])
    assert again.exceptAll(one).count() == 0 and again.count() == n
    assert 9_000 < budget.auto_sample(df, 100_000, 10_000).count() < 11_000


def test_run_check(spark, tables):
    assert result_of(S.run_check(spark, Check("n", "not_null", "orders", keys=["id"]), tables, AS_OF)).status == "pass"


def test_names_with_quotes(spark, tables):
    name = "it's a \\ \"name\""
    got = by_name(S.run_suite(spark, Suite("s'", [Check(name, "not_null", "orders", keys=["id"])]), tables, AS_OF, "r'1"))
    assert (got[name].suite, got[name].run_id) == ("s'", "r'1")


def test_zone_of_timestamps(spark, frame):
    """`timestamp` columns are compared in UTC in every session zone."""
    from tablecheck.operators import intervals, volume

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp'2024-03-10 00:30:00-05:00' as a, timestamp'2024-03-10 03:30:00-04:00' as b")
        r = result_of(volume.check_fresh(df, "b", 0, "2024-03-10 08:00:00"))
        assert r.observed == 1.0  # 07:30 UTC
        late = result_of(intervals.check_late_arrivals(df, "a", "b", 7199, 0.0))
        assert late.violations == 1  # two hours apart, in spite of the clock change
        assert result_of(intervals.check_late_arrivals(df, "a", "b", 7200, 0.0)).violations == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
