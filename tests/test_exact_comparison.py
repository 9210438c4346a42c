"""Numbers are compared as what they are written as, in their own type."""

import datetime as dt
from decimal import Decimal

import pytest
from single_row import result_of
from pyspark.sql import functions as F

from tablecheck.operators import evidence as E, rules, volume


@pytest.mark.parametrize(
    "left, right, tol, pct, bad",
    [
        (1e15 + 1, 1e15, 0, None, True),
        (1e15 + 2, 1e15, 1, None, True),
        (1e15 + 1, 1e15, 1, None, False),
        (0.3, 0.1, 0.2, None, False),
        (0.30001, 0.1, 0.2, None, True),
        (1e300, 2e300, 1, None, True),
        (1.1, 1.0, 0, 10.0, False),
        (1.1000001, 1.0, 0, 10.0, True),
        (float("nan"), 1.0, 5, None, True),
    ],
)
def test_doubles(frame, left, right, tol, pct, bad):
    df = frame([(left, right)], "l double, r double")
    assert result_of(rules.check_rule(df, "l == r", tol, pct)).violations == int(bad)
    r = volume.agg_match_frame(df.select(F.col("l").alias("v")), df.select(F.col("r").alias("v")), {"m": ("max", "v")}, (), tol, pct)
    assert result_of(r).m_ok is (not bad)


def test_whole_numbers_beyond_doubles(frame):
    df = frame([(2**53 + 1, 2**53), (2**60 + 1, 2**60 - 1)], "l bigint, r bigint")
    assert result_of(rules.check_rule(df, "l == r", 0)).violations == 2
    assert result_of(rules.check_rule(df, "l == r", 1)).violations == 1
    a, b = df.select(F.col("l").alias("v")), df.select(F.col("r").alias("v"))
    got = result_of(volume.agg_match_frame(a, b, {"s": ("sum", "v"), "m": ("max", "v")}, (), 1))
    assert (got.s_ok, got.m_ok, got.s_actual) == (False, False, 2**53 + 2**60 + 2)
    assert result_of(volume.agg_match_frame(a, b, {"s": ("sum", "v")}, (), 3)).s_ok


def test_times_and_texts_are_matched(frame):
    t = dt.datetime(2024, 1, 1)
    a = frame([("g", t, "x")], "g string, ts timestamp_ntz, s string")
    b = frame([("g", t, "y")], "g string, ts timestamp_ntz, s string")
    got = result_of(volume.agg_match_frame(a, b, {"t": ("min", "ts"), "s": ("max", "s")}, ["g"]))
    assert (got.t_ok, got.s_ok, got.t_actual) == (True, False, t)
    assert result_of(volume.check_agg_match(a, b, {"t": ("min", "ts")})).status == "pass"


def test_rules_between_texts_dates_and_within_conditions(frame):
    rows = [("a", "a", 1, 1.0), ("a == b", "a", 2, 2.005), (None, "x", 3, 5.0), ("c", "c", -1, -1.0)]
    df = frame(rows, "s string, t string, i int, d double")

    def bad(rule):
        return result_of(rules.check_rule(df, rule, 0.01)).violations

    assert bad("s == t") == 1
    assert bad("i == d") == 1
    assert bad("i == d AND i > 0") == 3  # a condition: 2 is not 2.005
    assert bad("s == 'a == b' OR i <> 2") == 0
    assert bad("s <=> t") == 2
    assert bad("date'2024-01-01' == date'2024-01-02'") == 4
    assert result_of(rules.check_rule(df, "s == t")).metrics["unknown_rows"] == "1"
    assert [r.i for r in rules.rule_rows(df, "i == d", 0.01).collect()] == [3]


def test_several_distinct_totals_and_large_ones(frame):
    rows = [("a", 1, "x", 1e15), ("a", 2, "x", 0.00004), ("b", 2, None, 1.5), ("b", 2, "z", None)]
    df = frame(rows, "batch string, u int, s string, v double")
    totals = ["DISTINCT(u)", "DISTINCT_s", "SUM(v)", "SUM(u)"]
    made = E.evidence_metrics(df, None, totals)
    assert tuple(made.first()) == (4, 2, 2, 1e15 + 1.50004, 7)
    assert "Expand" not in made._jdf.queryExecution().executedPlan().toString()
    by = E.evidence_metrics(df, None, totals, by=["batch"])
    assert {tuple(r) for r in by.collect()} == {("a", 2, 2, 1, 1e15 + 0.00004, 3), ("b", 2, 1, 1, 1.5, 4)}
    manifests = frame([("a", 2, 2, "1", 1e15, Decimal(3)), ("b", 2, 1, "2", 1.5, Decimal(4))],
                      "batch_id string, rowcount int, distinct_u int, distinct_s string, sum_v double, sum_u decimal(5,0)")
    got = {(r.batch_id, r.metric): r.within for r in E.reconcile_batches(df, "batch", manifests, totals).collect()}
    assert not got.pop(("b", "distinct_s")) and all(got.values()) and len(got) == 9


@pytest.mark.parametrize("expected, ok", [(2**60 + 1, True), (2**60, False), (str(2**60 + 1), True), ("x", False)])
def test_evidence_of_whole_numbers(frame, expected, ok):
    df = frame([(2**60,), (1,)], "v bigint")
    m = E.Manifest("b", 2, {"SUM(v)": expected})
    tol = E.EvidenceTolerance(totals_pct=0.0)
    got = {r.metric: r.within for r in E.reconcile_evidence(df, None, m, tol).collect()}
    assert got == {"rowcount": True, "sum_v": ok}
