"""Violating rows of every kind that has rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tablecheck.operators import evidence as E
from tablecheck.operators.payload import key_profile
from tablecheck.plans import registry, suite as S
from tablecheck.plans.catalog import table_schema
from tablecheck.plans.profile import profile
from tablecheck.spec import Check, Suite, Window

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
AS_OF = "2024-01-02 00:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    payloads = [
        '{"id": 1, "v": "1.0", "t": "2024-01-01 00:00:00", "items": [{"p": 1}]}',
        '{"id": 1, "v": "2.0", "t": "yesterday", "items": [{"p": 9}, {"p": 1}]}',
        '{"id": 3, "v": "1.0", "t": "2024-01-01 00:00:00", "items": []}',
    ]
    rows = [(i, i % 2, 10.0 * i, T0 + 5 * HOUR, p) for i, p in enumerate(payloads, 1)]
    main = spark.createDataFrame(rows, "k int, g int, amount double, arrived timestamp_ntz, payload string")
    history = [(1, T0, T0 + 2 * HOUR), (1, T0 + HOUR, None), (2, T0, T0 + HOUR), (2, T0 + 3 * HOUR, None)]
    return {
        "main": main,
        "parts": spark.createDataFrame([(1,)], "p bigint"),
        "groups": spark.createDataFrame([(0,)], "g int"),
        "other": main.withColumn("amount", F.expr("IF(g = 1, amount, amount + 5)")),
        "history": spark.createDataFrame(history, "k int, f timestamp_ntz, t timestamp_ntz"),
        "old_schema": table_schema(main.drop("g")).withColumn("dataset", F.lit("main")),
        "old_profile": profile(main.withColumn("amount", F.lit(1e6) + F.col("k")), exact_distinct=True),
        "old_keys": key_profile(main.withColumn("payload", F.lit('{"id": 1}')), "payload"),
        "wanted": spark.createDataFrame([(2,), (77,)], "key int"),
    }


def case(kind, want, name=None, dataset="main", **fields):
    return pytest.param(Check(name or kind, kind, dataset, **fields), want, id=name or kind)


MANIFEST = E.Manifest("b", 3, {"SUM(amount)": 99.0})
CASES = [
    case("json_unique", [{"json_value": "1", "duplicate_count": 2}], params={"path": "$.id"}),
    case("json_enum", [{"k": 2}], params={"path": "$.v", "values": ["1.0"]}),
    case("json_version", [{"k": 2}], params={"path": "$.v", "values": ["1.0"], "on_unknown": "warn"}),
    case("json_mapping", [{"k": 2}], params={"path": "$.id", "column": "k"}),
    case("json_timestamp", [{"k": 2}], params={"path": "$.t"}),
    case("json_late", [{"k": 1}, {"k": 3}], params={"path": "$.t", "arrival_ts": "arrived", "sla_seconds": 60}),
    case("json_child_fk", [{"k": 2, "child_id": 9}],
         params={"path": "$.items", "id_path": "$.p", "parent": "parts", "ref": "p"}),
    case("json_drift", [{"key": "items"}, {"key": "t"}, {"key": "v"}], params={"baseline": "old_keys"}),
    case("scd2", [
        {"k": 1, "f": "2024-01-01T01:00:00.000", "problems": ["overlap"]},
        {"k": 2, "f": "2024-01-01T03:00:00.000", "problems": ["gap"]},
    ], dataset="history", keys=["k"], params={"valid_from": "f", "valid_to": "t"}),
    case("fact_coverage", [{"k": 1, "missing": ["g"]}, {"k": 3, "missing": ["g"]}],
         params={"dimensions": [(["g"], "groups", ["g"])]}),
    case("agg_match", [{"g": 0, "s_ok": False}],
         params={"source": "other", "metrics": {"s": ("sum", "amount")}, "group_by": ["g"]}),
    case("evidence", [{"metric": "sum_amount", "within": False}], params={"manifest": MANIFEST}),
    case("reconciliation", [{"metric": "sum_amount"}], "by manifest", params={"manifest": MANIFEST}),
    case("reconciliation", [{"k": 1}, {"k": 3}], "by coverage", params={"dimensions": [(["g"], "groups", ["g"])]}),
    case("evidence_keys", [{"key": 77}], keys=["k"], params={"sample": "wanted"}),
    case("evidence_contract", [{"k": 2, "broken": ["mistyped $.v"]}], keys=["k"], filters=(),
         params={"payload": "payload", "paths": {"$.v": "STRING"}}),
    case("schema", [{"column": "k", "change": "type"}], params={"contract": [("k", "STRING", None)], "allow_extra": True}),
    case("drift", [{"column": "amount"}], "profile drift", params={"baseline_profile": "old_profile", "limits": {"max_mean_shift": 0.1}}),
    case("drift", [{"column": "g", "change": "column_added"}], "schema drift", params={"previous_schema": "old_schema"}),
    case("drift", [{"k": 2, "changed": 1, "changed_columns": ["amount"]}], "row drift", keys=["k"], params={"previous": "other"}),
    case("drift", [{"category": "1"}, {"category": "3"}], "category drift",
         params={"baseline": "other", "column": "amount", "threshold": -1.0, "bins": 3}),
]


@pytest.mark.parametrize("check, want", CASES)
def test_rows_of_a_failing_check(spark, tables, check, want):
    if check.type == "evidence_contract":
        main = tables["main"].withColumn("payload", F.expr("IF(k = 2, replace(payload, '\"2.0\"', '2.0'), payload)"))
        tables = {**tables, "main": main}
    suite = Suite("s", [check])
    results = S.execute_suite(spark, suite, tables, as_of=AS_OF)
    told = results.collect()
    assert [r.status for r in told] == ["fail"], told
    assert told[0].gate == check.params.get("on_unknown", "fail")
    rows = [json.loads(r.row) for r in S.sample_violations(spark, suite, results, tables, as_of=AS_OF).collect()]
    if check.name == "category drift":
        assert len(rows) >= 2
        return
    assert len(rows) == len(want), rows
    key = next(iter(want[0]))
    for got, expected in zip(sorted(rows, key=lambda r: str(r[key])), want):
        assert {k: got[k] for k in expected} == expected


def test_every_kind_has_rows_or_a_reason():
    without = set(registry.kinds()) - set(registry._ROWS)
    # One number decides these: there is no row to show.
    assert without == {"freshness", "row_count", "count_match", "json_flatten", "json_flatten_child", "evidence_checksum"}


def test_rows_are_masked_after_they_were_chosen(spark):
    df = spark.range(5000).select(F.concat(F.lit("user"), "id", F.lit("@mail.com")).alias("note"), F.lit(-1).alias("v"))
    suite = Suite("s", [Check("positive", "invariant", "t", expression="v > 0")])
    results = S.execute_suite(spark, suite, {"t": df}, as_of=AS_OF)
    out = S.sample_violations(spark, suite, results, {"t": df}, as_of=AS_OF, limit=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("TakeOrderedAndProject(limit=3") and "regexp" not in plan
    assert [json.loads(r.row)["v"] for r in out.collect()] == [-1, -1, -1]
    assert not any("user" in r.row and "@mail.com" in r.row for r in out.collect())


def test_samples_are_the_least_rows_by_json_text(spark):
    rows = [(v, o, t) for v in (None, -12, -1, 0, 1, 10, 12, 100) for o in (None, 5, 40) for t in (None, "a")]
    df = spark.createDataFrame(rows, "`value` bigint, other int, text string")
    suite = Suite("s", [Check("none", "invariant", "t", expression="false")])
    results = S.execute_suite(spark, suite, {"t": df}, as_of=AS_OF)
    want = sorted(r.j for r in df.select(F.to_json(F.struct("*")).alias("j")).collect())
    for limit in (1, 7, 20, 48):
        out = S.sample_violations(spark, suite, results, {"t": df}, as_of=AS_OF, limit=limit)
        assert sorted(r.row for r in out.collect()) == want[:limit]
    # The JSON text is no column of the rows that are ordered, only the second thing to order by.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "orderBy=[coalesce(CASE" in plan and "StructsToJson" not in plan.split("output=", 1)[1]
