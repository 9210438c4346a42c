import pytest
from single_row import result_of
from pyspark.sql import functions as F

from tablecheck.functions import payloads as P
from tablecheck.functions.predicates import Filter
from tablecheck.operators import payload as J
from tablecheck.operators.transform import TxSpec, apply_txspec


@pytest.mark.parametrize(
    "text, valid",
    [
        ('{"a":1}', True),
        ('{"a":1} x', False),
        ('{"a":1}{"b":2}', False),
        ('{"a":1}] , [2', False),
        ('1, "b": 2', False),
        ('{"a":1}, {"b":2}', False),
        ('1} , {"b":2', False),
        ('"x", "y"', False),
        ('{"a":1,"a":2}', False),
        ("", False),
        ("   ", False),
        ("null", True),
        ("[1,2]", True),
        ("[]", True),
        (' {"a": [1, {"b": null}]} ', True),
        ('"text"', True),
        ("nope", False),
        ('{"a":', False),
    ],
)
def test_strict_validity(frame, text, valid):
    df = frame([(text,)], "payload string")
    r = result_of(J.check_json_valid(df, "payload"))
    assert r.violations == int(not valid)
    assert (P.is_valid_json is not None) and r.metrics["total_rows"] == "1"


def test_null_payload_is_not_counted(frame):
    r = result_of(J.check_json_valid(frame([(None,), ("1",)], "payload string"), "payload"))
    assert (r.metrics["total_rows"], r.violations) == ("1", 0)


@pytest.mark.parametrize(
    "value, cls",
    [
        ('"s"', "STRING"),
        ("1", "NUMBER"),
        ("1.5", "NUMBER"),
        ("1e30", "NUMBER"),
        ("12345678901234567890123", "NUMBER"),
        ("true", "BOOLEAN"),
        ("[1]", "ARRAY"),
        ("[]", "ARRAY"),
        ('{"x":1}', "OBJECT"),
        ("{}", "OBJECT"),
        ("null", "NULL"),
    ],
)
def test_type_class(frame, value, cls):
    df = frame([(f'{{"a":{value}}}',)], "payload string")
    v = P.at(P.variant(F.col("payload")), "$.a")
    assert df.select(P.type_class(v)).first()[0] == cls


def test_json_null_is_present_and_wrong_type(frame):
    df = frame([('{"a":null}',), ('{"b":1}',), (None,), ("oops",)], "payload string")
    r = result_of(J.check_json_path(df, "payload", "$.a"))
    assert (r.metrics["path_exists_count"], r.violations) == ("1", 2)
    assert result_of(J.check_json_type(df, "payload", "$.a", "STRING")).violations == 1
    assert result_of(J.check_json_type(df, "payload", "$.a", "STRING", allow_null=True)).violations == 0


def test_nested_path(frame):
    df = frame([('{"t":{"total":[1,2]}}',), ('{"t":{}}',)], "payload string")
    assert result_of(J.check_json_path(df, "payload", "$.t.total[1]")).violations == 1


def test_unique_ignores_missing(frame):
    df = frame([('{"id":1}',), ('{"id":1}',), ('{"x":1}',), ('{"x":2}',)], "payload string")
    r = result_of(J.check_json_unique(df, "payload", "$.id"))
    assert (r.violations, r.metrics["total_duplicates"]) == (1, "2")


def test_flatten(frame):
    df = frame([('{"i":[1,2,3]}',), ('{"i":[]}',), ('{"x":1}',), ('{"i":7}',)], "payload string")
    r = result_of(J.check_flatten(df, "payload", "$.i"))
    assert (r.metrics["source_rows"], r.metrics["flattened_rows"], r.violations) == ("4", "3", 1)
    assert J.explode_items(df, "payload", "$.i").count() == 3
    assert J.explode_items(df, "payload", "$.i", keep_empty=True).count() == 6
    child = frame([(1,), (2,), (3,)], "id int")
    assert result_of(J.check_flatten_child(df, "payload", "$.i", child)).status == "pass"


def test_mapping_adds_up(frame):
    df = frame(
        [('{"a":1}', 1), ('{"a":2}', 1), ('{"b":2}', 1), ('{"a":null}', 1), ('{"a":"x"}', 1), ('{"a":1}', None)],
        "payload string, col int",
    )
    r = result_of(J.check_json_mapping(df, "payload", "$.a", "col"))
    m = r.metrics
    assert [m[x] for x in ("total_rows", "matching_rows", "mismatched_rows", "missing_path")] == ["5", "1", "2", "2"]


def test_enum_version_timestamp(frame):
    df = frame([('{"s":"a","t":"2024-01-01 10:00:00"}',), ('{"s":"z","t":"never"}',), ("{}",)], "payload string")
    assert result_of(J.check_json_enum(df, "payload", "$.s", ["a"])).violations == 1
    r = result_of(J.check_json_version(df, "payload", "$.s", ["a"], "warn"))
    assert (r.gate, r.status) == ("warn", "fail")
    assert result_of(J.check_json_timestamp(df, "payload", "$.t")).violations == 1


def test_child_fk(frame):
    df = frame([('{"i":[{"p":1},{"p":5},{"p":5},{"q":1}]}',)], "payload string")
    parent = frame([(1,), (2,)], "id bigint")
    r = result_of(J.check_json_child_fk(df, "payload", "$.i", "$.p", parent, "id"))
    assert (r.violations, r.metrics["orphan_keys"]) == (2, "1")


def test_key_profile_and_drift(frame):
    old = frame([('{"a":1,"l":[1]}',)] * 4, "payload string")
    new = frame([('{"a":"x","l":[1,2,3]}',)] * 2 + [('{"a":1}',)] * 2 + [("bad",)], "payload string")
    prof = {(r.key, r.type): (r.n, r.length, r.objects) for r in J.key_profile(new, "payload").collect()}
    assert prof == {("a", "STRING"): (2, 0, 4), ("a", "NUMBER"): (2, 0, 4), ("l", "ARRAY"): (2, 6, 4)}
    r = result_of(J.check_json_drift(new, "payload", J.key_profile(old, "payload")))
    assert (r.violations, r.metrics["appeared"]) == (3, "1")
    same = J.check_json_drift(old, "payload", J.key_profile(old, "payload"))
    assert result_of(same).status == "pass"


def test_one_parse_per_fused_scan(spark, frame):
    from tablecheck.plans.suite import run_suite
    from tablecheck.spec import Check, Suite

    df = frame([('{"a":1}',)], "payload string")
    suite = Suite(
        "j",
        [
            Check("v", "json_valid", "d"),
            Check("p", "json_path", "d", params={"path": "$.a"}),
            Check("t", "json_type", "d", params={"path": "$.a", "expected": "NUMBER"}),
            Check("e", "json_enum", "d", params={"path": "$.a", "values": ["1"]}),
        ],
    )
    out = run_suite(spark, suite, {"d": df})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    assert plan.count("parseJson(concat([,") == 1
    assert {r.status for r in out.collect()} == {"pass"}


def test_variant_column(frame):
    df = frame([('{"a":1}',)], "s string").select(F.parse_json("s").alias("payload"))
    assert result_of(J.check_json_path(df, "payload", "$.a")).status == "pass"


def test_project_and_txspec(frame):
    df = frame([(1, '{"o":{"t":"5.5"},"i":[{"q":1},{"q":9}]}'), (2, "{}")], "id int, payload string")
    out = J.project_paths(df, "payload", {"t": ("$.o.t", "double"), "n": ("$.none", "int")}, keep=["id"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 5.5, None), (2, None, None)]
    spec = TxSpec(
        "payload",
        {"t": ("$.o.t", "double")},
        explode="$.i",
        item_mapping={"q": ("$.q", "int")},
        filters=[Filter("q", "gt", 0)],
        rules={"small": "q < 5", "same": "q == t"},
        keep=["id"],
    )
    got = {r.q: r.broken_rules for r in apply_txspec(df, spec).collect()}
    assert got == {1: ["same"], 9: ["small", "same"]}


@pytest.mark.parametrize(
    "text, valid",
    [
        ("1", True), ("null", True), (' {"a": [1, 2]} ', True), ("[[1],[2]]", True), ('"]"', True), ("[]", True),
        ("", False), ("1,2", False), ("null,null", False), ("1]", False), ("1],[2]", False), ("{}] [", False),
        ("1] x", False), ('1], "b":[2', False), ('{"a":1} x', False), ('{"a":1,"a":2}', False), ("1}", False), (None, False),
    ],
)
def test_exactly_one_value(frame, text, valid):
    assert frame([(text,)], "p string").select(P.is_valid_json(F.col("p"))).first()[0] is valid


def test_violating_rows_parse_once(spark):
    df = J.with_parsed(spark.createDataFrame([(1, '{"k": 2}'), (2, '{"k": 2}'), (3, None)], "n bigint, payload string"), "payload")
    wrong = J.wrong_type_rows(df, "payload", "$.k", "STRING"), J.mapping_rows(df, "payload", "$.k", "n")
    assert [sorted(r.n for r in found.collect()) for found in wrong] == [[1, 2], [1]]
    for found in wrong:
        plan = found.drop("_v_payload")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[,") == 1, plan
