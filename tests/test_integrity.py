import datetime as dt

import pytest
from single_row import result_of
from hypothesis import HealthCheck, given, settings, strategies as st

from tablecheck.operators import integrity, rules, volume


def keyed(frame, rows):
    return frame(rows, "k int, v string")


@pytest.mark.parametrize(
    "rows, groups, total",
    [
        ([], 0, 0),
        ([(1, "a"), (2, "b")], 0, 0),
        ([(1, "a"), (1, "b"), (2, "c")], 1, 2),
        ([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "e")], 2, 5),
        ([(None, "a"), (None, "b"), (3, "c")], 1, 2),
    ],
)
def test_unique(frame, rows, groups, total):
    r = result_of(integrity.check_unique(keyed(frame, rows), ["k"]))
    assert r.violations == groups
    assert r.metrics["total_duplicates"] == str(total)
    assert r.metrics["total_rows"] == str(len(rows))
    assert r.status == ("pass" if groups == 0 else "fail")


def test_unique_composite_and_tolerance(frame):
    df = keyed(frame, [(1, "a"), (1, "a"), (1, "b")])
    assert result_of(integrity.check_unique(df, ["k", "v"])).status == "fail"
    assert result_of(integrity.check_unique(df, ["k", "v"], dup_rows=1)).status == "pass"


def test_duplicate_rows_include_null_keys(frame):
    df = keyed(frame, [(None, "a"), (None, "b"), (1, "c"), (2, "d"), (2, "e")])
    assert sorted(r.v for r in integrity.duplicate_rows(df, ["k"]).collect()) == ["a", "b", "d", "e"]


def test_top_duplicates_order(frame):
    df = keyed(frame, [(2, ""), (2, ""), (1, ""), (1, ""), (3, ""), (3, ""), (3, "")])
    assert [r.k for r in integrity.top_duplicates(df, ["k"], 2).collect()] == [3, 1]


def test_not_null_counts_every_key(frame):
    df = keyed(frame, [(1, "a"), (None, "b"), (2, None), (None, None)])
    r = result_of(integrity.check_not_null(df, ["k", "v"]))
    assert (r.violations, r.metrics["null_count.k"], r.metrics["null_count.v"]) == (3, "2", "2")
    assert r.metrics["total_rows"] == "4"
    assert result_of(integrity.check_not_null(keyed(frame, []), ["k"])).status == "pass"


def test_dim_complete_blank(frame):
    df = keyed(frame, [(1, " "), (2, ""), (3, None), (4, "x")])
    r = result_of(integrity.check_dim_complete(df, ["v"]))
    assert r.violations == 3


def test_foreign_key(frame):
    child = frame([(1, "x"), (2, "x"), (2, "x"), (None, "x"), (9, "y"), (9, None)], "a int, b string")
    parent = frame([(1, "x"), (1, "x"), (2, "x")], "a int, b string")
    r = result_of(integrity.check_foreign_key(child, ["a"], parent, ["a"]))
    assert (r.violations, r.metrics["orphan_keys"]) == (2, "1")
    r = result_of(integrity.check_foreign_key(child, ["a", "b"], parent, ["a", "b"]))
    assert (r.violations, r.metrics["orphan_keys"]) == (1, "1")


def test_fact_coverage_counts_nulls_and_duplicate_parents(frame):
    fact = frame([(1, 10), (1, 10), (2, 10), (None, 10), (1, 99)], "a int, b int")
    da = frame([(1,), (1,), (2,)], "id int")
    db = frame([(10,)], "id int")
    r = result_of(integrity.check_fact_coverage(fact, [(["a"], da, ["id"]), (["b"], db, ["id"])]))
    assert (r.violations, r.metrics["covered_rows"], r.metrics["total_rows"]) == (2, "3", "5")
    assert (r.metrics["missing.a"], r.metrics["missing.b"]) == ("1", "1")
    ok = integrity.check_fact_coverage(fact, [(["a"], da, ["id"])], min_rate=0.8)
    assert result_of(ok).status == "pass"


def test_allowed_values_ignore_null(frame):
    df = keyed(frame, [(1, "a"), (2, "z"), (3, None)])
    assert result_of(integrity.check_allowed_values(df, "v", ["a"])).violations == 1
    lookup = frame([("a",), ("b",)], "value string")
    r = result_of(integrity.check_allowed_values(df, "v", lookup))
    assert (r.violations, r.metrics["unknown_values"]) == (1, "1")


def test_invariant_null(frame):
    df = keyed(frame, [(1, "a"), (None, "b"), (-1, "c")])
    assert result_of(integrity.check_invariant(df, "k > 0")).violations == 1
    assert result_of(integrity.check_invariant(df, "k > 0", null_is_violation=True)).violations == 2


def test_idempotent(frame):
    df = frame([(1, "b1"), (1, "b1"), (2, "b1"), (2, "b2"), (None, "b1"), (None, "b2")], "id int, batch string")
    r = result_of(integrity.check_idempotent(df, "id", "batch"))
    assert (r.violations, r.metrics["reloaded_rows"]) == (1, "2")


# ------------------------------------------------------------------- freshness


@pytest.mark.parametrize(
    "newest, as_of, hours, elapsed, lag, status",
    [
        ("2024-01-01 00:59:59", "2024-01-01 01:00:01", 0, False, 1, "fail"),
        ("2024-01-01 00:59:59", "2024-01-01 01:00:01", 0, True, 0, "pass"),
        ("2024-01-01 00:00:00", "2024-01-02 00:00:00", 24, False, 24, "pass"),
        ("2024-01-01 00:00:00", "2024-01-02 00:00:01", 24, True, 24, "pass"),
        ("2024-01-01 00:00:00", "2024-01-02 01:00:00", 24, False, 25, "fail"),
        ("2024-01-03 00:00:00", "2024-01-02 00:00:00", 24, False, -24, "pass"),
    ],
)
def test_fresh(frame, newest, as_of, hours, elapsed, lag, status):
    df = frame([(dt.datetime.fromisoformat(newest),), (None,)], "ts timestamp_ntz")
    r = result_of(volume.check_fresh(df, "ts", hours, as_of, elapsed))
    assert (r.observed, r.status, r.violations) == (lag, status, max(0, lag - hours))


def test_fresh_without_data(frame):
    r = result_of(volume.check_fresh(frame([], "ts timestamp_ntz"), "ts", 24, "2024-01-01 00:00:00"))
    assert (r.status, r.error_message, r.violations) == ("fail", "No data found", 1)
    df = frame([(None,)], "ts timestamp_ntz")
    assert result_of(volume.check_fresh(df, "ts", 24, "2024-01-01 00:00:00")).status == "fail"


# --------------------------------------------------------------------- volumes


@pytest.mark.parametrize("lo, hi, bad", [(1, 3, 0), (3, 3, 0), (4, None, 1), (None, 1, 2), (None, None, 0)])
def test_row_count(frame, lo, hi, bad):
    df = keyed(frame, [(1, ""), (2, ""), (3, "")])
    assert result_of(volume.check_row_count(df, lo, hi)).violations == bad


def test_row_count_stable(frame):
    df = keyed(frame, [(i, "") for i in range(110)])
    assert result_of(volume.check_row_count_stable(df, 100, 10.0)).status == "pass"
    assert result_of(volume.check_row_count_stable(df, 99, 10.0)).status == "fail"
    assert result_of(volume.check_row_count_stable(df, 0, 10.0)).status == "fail"
    assert result_of(volume.check_row_count_stable(keyed(frame, []), 0, 10.0)).status == "pass"


def test_count_match(frame):
    a, b = keyed(frame, [(1, ""), (2, "")]), keyed(frame, [(1, "")])
    assert result_of(volume.check_count_match(a, b)).violations == 1
    assert result_of(volume.check_count_match(a, b, abs_tol=1)).status == "pass"
    assert result_of(volume.check_count_match(keyed(frame, []), keyed(frame, []))).status == "pass"


def test_agg_match_groups(frame):
    a = frame([("x", 1.0), ("x", 2.0), ("y", 5.0), (None, 1.0)], "g string, v double")
    b = frame([("x", 3.005), ("z", 5.0), (None, 1.0)], "g string, v double")
    r = result_of(volume.check_agg_match(a, b, {"s": ("sum", "v")}, ["g"], abs_tol=0.01))
    assert (r.violations, r.metrics["missing_groups"]) == (2, "2")
    r = result_of(volume.check_agg_match(a, a, {"s": ("sum", "v"), "n": ("count", "*")}))
    assert r.status == "pass"


# ----------------------------------------------------------------------- rules


@pytest.mark.parametrize(
    "left, right, bad",
    [
        (1.0, 1.0, False),
        (100.01, 100.0, False),  # exactly the tolerance, in spite of binary fractions
        (0.3, 0.31, False),
        (100.02, 100.0, True),
        (-5.0, -5.02, True),
        (None, 1.0, None),
    ],
)
def test_rule_tolerance(frame, left, right, bad):
    df = frame([(left, right)], "l double, r double")
    r = result_of(rules.check_rule(df, "l == r", 0.01))
    assert r.violations == int(bad is True)
    assert r.metrics["unknown_rows"] == str(int(bad is None))


def test_rule_pct_needs_both(frame):
    df = frame([(110.0, 100.0), (1.1, 1.0), (1.0, 0.0)], "l double, r double")
    r = result_of(rules.check_rule(df, "l == r", 0.5, 5.0))
    assert r.violations == 2
    assert float(r.metrics["avg_difference"]) == 5.5


def test_rule_decimal_is_exact(frame):
    from decimal import Decimal

    df = frame([(Decimal("1.01"), Decimal("1.00"))], "l decimal(10,2), r decimal(10,2)")
    assert result_of(rules.check_rule(df, "l == r", 0.01)).status == "pass"


def test_rule_condition_and_rows(frame):
    df = keyed(frame, [(1, ""), (5, ""), (None, "")])
    assert result_of(rules.check_rule(df, "k < 3")).violations == 1
    assert [r.k for r in rules.rule_rows(df, "k < 3").collect()] == [5]


# ------------------------------------------------------------------ properties

_ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.sampled_from(["a", "b"])), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=_ROWS)
def test_unique_matches_python(spark, rows):
    from collections import Counter

    df = spark.createDataFrame(rows, "k int, v string")
    counts = Counter(r[0] for r in rows)
    r = result_of(integrity.check_unique(df, ["k"]))
    assert r.violations == sum(n > 1 for n in counts.values())
    assert (r.violations == 0) == (r.status == "pass")
    twice = result_of(integrity.check_unique(df.unionByName(df), ["k"]))
    assert twice.violations >= r.violations


def test_coverage_without_broadcast(spark, frame):
    """Large dimensions: the fact is reduced before each join; same answer."""
    fact = frame([(1, 10)] * 50 + [(2, 10), (None, 10), (1, 99)], "a int, b int")
    da, db = frame([(1,), (2,)], "id int"), frame([(10,)], "id int")
    dims = [(["a"], da, ["id"]), (["b"], db, ["id"])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = result_of(integrity.check_fact_coverage(fact, dims))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert (r.violations, r.metrics["total_rows"], r.metrics["missing.a"]) == (2, "53", "1")
