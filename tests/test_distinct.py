"""Exact distinct counts and profiles without repeated rows."""

import datetime as dt

from pyspark.sql import functions as F

from tablecheck.operators.distinct import distinct_counts
from tablecheck.plans.profile import profile, propose_keys


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_by_type(frame):
    nan, t = float("nan"), dt.datetime(2024, 1, 1)
    rows = [
        ("g", 1, 0.0, "a", "x" * 40, [1, 2], t, True, (1, None)),
        ("g", 1, -0.0, "a ", "x" * 40, [1, 2], t, True, (1, None)),
        ("g", 2, nan, "", "x" * 39 + "y", [1, None], t, False, (None, "1")),
        ("h", 2, nan, None, None, [], None, None, None),
        (None, None, 1e300, "a", "x" * 32, None, t, None, (1, "")),
    ]
    df = frame(
        rows,
        "g string, i int, d double, s string, w string, a array<int>, t timestamp_ntz, b boolean, r struct<p int, q string>",
    )
    names = [c for c in df.columns if c != "g"]
    counts = distinct_counts(df, {n: F.col(n) for n in names}).first().counts
    assert counts == {n: df.agg(F.count_distinct(n)).first()[0] for n in names}
    by = {r.g: r.counts for r in distinct_counts(df, {n: F.col(n) for n in names}, by=["g"]).collect()}
    assert by["g"] == {"i": 2, "d": 2, "s": 3, "w": 2, "a": 2, "t": 1, "b": 2, "r": 2}
    assert by["h"] == {"i": 1, "d": 1, "a": 1} and by[None]["d"] == 1


def test_no_rows(frame):
    df = frame([], "a int, b string")
    assert distinct_counts(df, {"a": F.col("a")}).first().counts == {}
    got = {r.column: (r.row_count, r.distinct_count) for r in profile(df, exact_distinct=True).collect()}
    assert got == {"a": (0, 0), "b": (0, 0)}
    assert propose_keys(df).count() == 2
    assert propose_keys(frame([(None, None)], "a int, b string")).collect() == []


def test_profile_repeats_no_rows_and_keeps_all_places(spark):
    df = spark.sql("SELECT id, IF(id = 0, 1e15, 0.00004D) v, CAST(id % 3 AS STRING) s FROM range(1000)")
    made = profile(df, "d", exact_distinct=True)
    assert "Expand" not in plan_of(made)
    got = {r.column: r for r in made.collect()}
    assert (got["v"].min, got["v"].max, got["v"].distinct_count) == ("0.00004", "1000000000000000", 2)
    assert got["v"].avg == (1e15 + 0.03996) / 1000
    assert (got["id"].distinct_count, got["s"].distinct_count) == (1000, 3)


def test_values_are_reduced_inside_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    plan = plan_of(distinct_counts(df, {"a": F.col("a"), "b": F.col("b")}))
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(_i" in x]
    assert exchanges and all("HashAggregate(keys=[_i" in lines[i + 1] for i in exchanges)


def test_every_full_column_is_counted(spark):
    """No sketch decides which columns are counted."""
    df = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("key"), "id").alias("s"), (F.col("id") % 4999).alias("n"))
    assert {r.column for r in propose_keys(df).collect()} == {"k", "s"}
    assert "approx" not in plan_of(propose_keys(df))
