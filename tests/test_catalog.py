import hashlib
import json

import pytest
from single_row import result_of

from tablecheck.operators import contracts, drift, snapshots
from tablecheck.plans import catalog as K, lineage as L, proposals as T
from tablecheck.plans.profile import profile, propose_keys
from tablecheck.spec import DatasetMeta, ForeignKey

COLS = "dataset string, column string, type string, nullable boolean"


def write(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(json.dumps(value, indent=1))
    return str(path)


PACKAGE = {
    "version": "1.0",
    "generated_at": "2024-01-01T00:00:00Z",
    "environment": "test",
    "datasets": [
        {
            "name": "RAW.ORDERS",
            "kind": "table",
            "row_count_estimate": 10,
            "columns": [
                {"name": "ORDER_ID", "type": "NUMBER", "nullable": False},
                {"name": "CUSTOMER_ID", "type": "NUMBER"},
            ],
            "primary_key": ["ORDER_ID"],
            "foreign_keys": [{"columns": ["CUSTOMER_ID"], "ref": "DIM.CUSTOMER(CUSTOMER_ID)"}],
            "watermark_column": "ORDER_TS",
            "lineage": ["SRC.ORDERS_RAW"],
        }
    ],
}


def test_package(spark, tmp_path):
    path = write(tmp_path, "catalog.json", PACKAGE)
    c = K.catalog_from_package(spark, path)
    assert [(r.column, r.type, r.nullable) for r in c.columns.collect()] == [("ORDER_ID", "NUMBER", False), ("CUSTOMER_ID", "NUMBER", True)]
    meta = K.dataset_metas(c)["RAW.ORDERS"]
    assert meta.primary_key == ("ORDER_ID",)
    assert meta.foreign_keys == (ForeignKey(("CUSTOMER_ID",), "DIM.CUSTOMER", ("CUSTOMER_ID",)),)
    assert L.lineage_edges(c.datasets).collect()[0].upstream == "SRC.ORDERS_RAW"
    listed = K.list_catalogs(spark, path, environment="test").collect()
    assert (len(listed), listed[0].dataset_count) == (1, 1)
    assert K.list_catalogs(spark, path, environment="prod").count() == 0


def test_dbt_files(spark, tmp_path):
    manifest = {
        "nodes": {
            "model.a": {"resource_type": "model", "name": "a", "columns": {"id": {"data_type": "NUMBER"}, "x": {"description": "d"}}, "depends_on": {"nodes": ["model.b", "source.c"]}},
            "test.t": {"resource_type": "test", "name": "t"},
        }
    }
    c = K.catalog_from_dbt_manifest(spark, write(tmp_path, "manifest.json", manifest))
    assert {(r.column, r.type) for r in c.columns.collect()} == {("id", "NUMBER"), ("x", "STRING")}
    d = c.datasets.collect()
    assert (len(d), d[0].kind, sorted(d[0].lineage)) == (1, "view", ["model.b", "source.c"])
    cat = {"nodes": {"n1": {"metadata": {"name": "t1", "type": "table"}, "stats": {"row_count": {"value": 12}}, "columns": {"c": {"type": "TEXT", "comment": "hi"}}}, "n2": {"metadata": {"name": "t2"}, "columns": {}}}}
    c = K.catalog_from_dbt_catalog(spark, write(tmp_path, "dbt_catalog.json", cat))
    got = {r.dataset: (r.kind, r.row_count_estimate) for r in c.datasets.collect()}
    assert got == {"t1": ("table", 12), "t2": ("table", None)}
    assert c.columns.first().description == "hi"


def test_signature_sorts_by_name_not_by_text(frame):
    cols = frame([("d", "a_b", "X", True), ("d", "a", "X", False), ("d", "a1", "X", True)], COLS)
    text = "a:X:False|a1:X:True|a_b:X:True"
    assert K.dataset_signatures(cols).first().signature == hashlib.sha256(text.encode()).hexdigest()


def test_diff(frame):
    prev = frame([("a", "x", "INT", True), ("a", "y", "INT", True), ("a", "n", "INT", True), ("gone", "x", "INT", True), ("same", "x", "INT", True)], COLS)
    cur = frame([("a", "x", "STR", True), ("a", "z", "INT", True), ("a", "n", "INT", False), ("new", "x", "INT", True), ("same", "x", "INT", True)], COLS)
    got = {(r.dataset, r.change, r.column, r.from_type, r.to_type) for r in K.catalog_diff(cur, prev).collect()}
    assert got == {
        ("a", "dataset_modified", None, None, None),
        ("a", "type_changed", "x", "INT", "STR"),
        ("a", "column_removed", "y", "INT", None),
        ("a", "column_added", "z", None, "INT"),
        ("a", "nullable_changed", "n", "true", "false"),
        ("gone", "dataset_removed", None, None, None),
        ("new", "dataset_added", None, None, None),
    }
    assert result_of(contracts.check_schema_drift(cur, prev)).violations == 6
    assert result_of(contracts.check_schema_drift(cur, cur)).status == "pass"


def test_schema_contract(frame):
    df = frame([], "id bigint, name string, ts timestamp_ntz")
    ok = [("id", "NUMBER", None), ("name", "varchar(20)", None), ("ts", "TIMESTAMP", None)]
    assert result_of(contracts.check_schema(df, ok)).status == "pass"
    r = result_of(contracts.check_schema(df, [("id", "STRING", None), ("gone", "NUMBER", None), ("name", "STRING", False)]))
    assert {k: r.metrics[k] for k in ("missing", "extra", "type", "nullable")} == {"missing": "1", "extra": "1", "type": "1", "nullable": "1"}
    assert result_of(contracts.check_schema(df, ok[:1], allow_extra=True)).status == "pass"


@pytest.mark.parametrize(
    "edges, changed, want",
    [
        ([("a", "b"), ("b", "c"), ("x", "y")], ["a"], {"a": 0, "b": 1, "c": 2}),
        ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], ["a"], {"a": 0, "b": 1, "c": 1, "d": 2}),
        ([("a", "b"), ("b", "a")], ["a"], {"a": 0, "b": 1}),
        ([("a", "a")], ["a"], {"a": 0}),
        ([("a", "b")], [], {}),
    ],
)
def test_downstream(frame, edges, changed, want):
    e = frame(edges, "upstream string, downstream string")
    c = frame([(x,) for x in changed], "dataset string")
    assert {r.dataset: r.depth for r in L.downstream(e, c).collect()} == want


def test_select_impacted(frame):
    e = frame([("a", "b")], "upstream string, downstream string")
    suite = frame([("t1", "b"), ("t2", "z")], "test string, dataset string")
    diff = frame([("a",)], "dataset string")
    assert [r.test for r in L.select_impacted(suite, diff, e).collect()] == ["t1"]


def test_profile_and_keys(frame):
    df = frame([(1, "a", 1.5, None), (2, "a", None, None), (3, None, 2.5, None)], "id int, s string, v double, n int")
    got = {r.column: r for r in profile(df, exact_distinct=True).collect()}
    assert (got["s"].null_count, got["s"].distinct_count, got["v"].avg) == (1, 1, 2.0)
    assert (got["n"].null_rate, got["n"].min, got["n"].avg) == (1.0, None, None)
    assert [r.column for r in propose_keys(df).collect()] == ["id"]
    empty = {r.column: r for r in profile(df.filter("id > 9"), exact_distinct=True).collect()}
    assert (empty["id"].row_count, empty["id"].null_rate) == (0, None)


def test_profile_drift(frame):
    a = frame([(float(i % 10), "x") for i in range(100)], "v double, s string")
    b = frame([(float(i % 10) + 20, "x" if i % 2 else None) for i in range(100)], "v double, s string")
    pa, pb = profile(a, exact_distinct=True), profile(b, exact_distinct=True)
    assert result_of(drift.check_profile_drift(pa, pa)).status == "pass"
    got = {r.column: r.drifted for r in drift.profile_drift_rows(pb, pa).collect()}
    assert got == {"v": True, "s": True}


def test_category_drift(frame):
    base = frame([("a",)] * 50 + [("b",)] * 50, "c string")
    r = result_of(drift.check_category_drift(base, base, "c"))
    assert (r.status, r.observed) == ("pass", 0.0)
    moved = frame([("a",)] * 95 + [("z",)] * 5, "c string")
    r = result_of(drift.check_category_drift(moved, base, "c"))
    assert (r.status, r.metrics["appeared"], r.metrics["vanished"]) == ("fail", "1", "1")


def test_drift_of_whole_numbers(frame):
    base = frame([(i,) for i in range(0, 1000, 2)] + [(None,)], "c bigint")
    odd = frame([(i,) for i in range(1, 1000, 2)] + [(None,)], "c bigint")
    r = result_of(drift.check_category_drift(odd, base, "c"))
    assert (r.status, r.metrics["appeared"]) == ("pass", "0")  # the last bin holds the maximum and all above
    assert result_of(drift.check_category_drift(odd, base, "c", bins=None)).status == "fail"
    shares = {x.category: x.base for x in drift.category_shares(odd, base, "c").collect()}
    assert shares[None] == 1


def test_snapshots_with_copies(frame):
    prev = frame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, None)], "k int, v string")
    cur = frame([(1, "x"), (2, "b"), (5, "e"), (4, None)], "k int, v string")
    r = result_of(snapshots.compare_snapshots(cur, prev, ["k"]))
    m = r.metrics
    assert (m["added"], m["removed"], m["changed"], m["changed.v"]) == ("1", "2", "1", "1")
    diff = {(x.side, x.k, x.v, x.copies) for x in snapshots.except_both(cur, prev).collect()}
    assert diff == {("current_only", 1, "x", 1), ("previous_only", 1, "a", 1), ("previous_only", 2, "b", 1), ("previous_only", 3, "c", 1), ("current_only", 5, "e", 1)}
    assert result_of(snapshots.compare_snapshots(prev, prev, ["k"])).status == "pass"


def test_failure_profile(frame):
    df = frame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "c string, n int")
    got = [(r.dimension, r.value, r.violations) for r in snapshots.failure_profile(df, ["c", "n"], 1).collect()]
    assert sorted(got) == [("c", "a", 2), ("n", "1", 3)]


@pytest.mark.parametrize(
    "name, layer",
    [("RAW.X", "RAW"), ("raw.x", "RAW"), ("STAGE.X", "PREP"), ("PREP.X", "PREP"), ("FACT.X", "MART"), ("DIM.X", "MART"), ("MART.X", "MART"), ("RAWX", "UNKNOWN")],
)
def test_layers(frame, name, layer):
    assert T.layer_of(name) == layer
    df = frame([(name,)], "d string")
    assert df.select(T.detect_layer(df.d)).first()[0] == layer


def test_proposals(spark, frame):
    tables = {n: frame([], "id int") for n in ("RAW.ORDERS", "PREP.ORDERS", "PREP.ITEMS", "DIM.C", "FACT.S", "X.Y")}
    metas = {"RAW.ORDERS": DatasetMeta("RAW.ORDERS", primary_key=("ORDER_ID",)), "PREP.ORDERS": DatasetMeta("PREP.ORDERS", foreign_keys=(ForeignKey.of(["c"], "DIM.C(id)"),))}
    datasets = K.catalog_from_tables(tables, metas).datasets

    def names(profile, layers=None):
        return sorted(r.test for r in T.propose_tests(datasets, profile=profile, layers=layers).collect())

    assert names("smoke", ["raw"]) == ["not_null_key_raw_orders", "pk_uniqueness_raw_orders"]
    assert names("standard", ["RAW"]) == ["freshness_raw_orders", "not_null_key_raw_orders", "pk_uniqueness_raw_orders"]
    assert len(names("deep", ["RAW"])) == 4
    assert names("standard", ["PREP"]) == [
        "fk_integrity_prep_items", "fk_integrity_prep_orders", "schema_contract_prep_items", "schema_contract_prep_orders", "total_consistency_prep_orders",
    ]
    assert names("standard", ["MART"]) == ["dim_completeness_dim_c", "fact_dim_coverage_fact_s"]
    assert len(names("deep", ["MART"])) == 4
    rows = {r.test: r for r in T.propose_tests(datasets, profile="smoke").collect()}
    pk = rows["pk_uniqueness_raw_orders"]
    assert (pk.keys, pk.severity, pk.gate, pk.confidence, pk.auto_approvable) == (["ORDER_ID"], "blocker", "fail", 0.95, False)
    assert rows["fk_integrity_prep_orders"].expression == "c references DIM.C"
    with pytest.raises(ValueError):
        T.propose_tests(datasets, profile="everything")


def test_tolerance(frame):
    h = frame([("t", float(v)) for v in (10, 11, 12, 13, 100)] + [("u", 5.0)], "test string, observed double")
    got = {r.test: (r.center, r.deviation, r.tolerance) for r in T.propose_tolerance(h).collect()}
    assert got == {"t": (12.0, 1.0, 3.0), "u": (5.0, 0.0, 0.01)}


def test_list_datasets(frame):
    d = K.catalog_from_tables({n: frame([], "id int") for n in ("b.X", "a.x", "c.y")}).datasets
    assert [r.dataset for r in K.list_datasets(d, "X", "table", 1, 1).collect()] == ["b.X"]


def test_profile_of_unusual_columns(spark):
    df = spark.sql("select array(1,2) as a, map('k',1) as m, parse_json('{\"x\":1}') as v, true as b, date'2024-01-01' as d, named_struct('z',1) as s")
    got = {r.column: r for r in profile(df).collect()}
    assert got["a"].distinct_count == 1 and got["m"].distinct_count is None and got["v"].null_count == 0
    assert (got["b"].min, got["d"].max, got["s"].min) == ("true", "2024-01-01", None)
