"""Differences of snapshots against counting whole rows."""

import random
from collections import Counter

import pytest
from single_row import result_of
from pyspark.sql import functions as F

from tablecheck.operators import snapshots
from tablecheck.operators.integrity import uncovered_rows

SCHEMA = "k int, a string, b string, d double, n int"


def table(rng, n):
    return [
        (rng.choice([None, *range(30)]), rng.choice([None, "x", ""]), rng.choice([None, "x"]), rng.choice([0.0, 1.5, None]), 1)
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed, n", [(1, 0), (2, 40), (3, 400)])
def test_except_both(frame, seed, n):
    rng = random.Random(seed)
    cur, prev = table(rng, n), table(rng, n // 2)
    prev += cur[: n // 3]
    want = Counter(cur)
    want.subtract(prev)
    got = snapshots.except_both(frame(cur, SCHEMA), frame(prev, SCHEMA)).collect()
    found = {tuple(r)[2:]: r.copies * (1 if r.side == "current_only" else -1) for r in got}
    assert len(found) == len(got) and found == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("seed", [4, 5])
def test_key_changes(frame, seed):
    rng = random.Random(seed)
    cur = table(rng, 120)
    prev = [(r[0], r[1], r[2], rng.choice([r[3], 9.0]), r[4]) for r in cur if rng.random() < 0.8] + table(rng, 10)
    got = {r.k: r for r in snapshots.key_changes(frame(cur, SCHEMA), frame(prev, SCHEMA), ["k"]).collect()}
    net = Counter(cur)
    net.subtract(prev)
    for k in {r[0] for r in cur + prev}:
        plus = {r: c for r, c in net.items() if r[0] == k and c > 0}
        minus = {r: -c for r, c in net.items() if r[0] == k and c < 0}
        p, m = sum(plus.values()), sum(minus.values())
        if not p and not m:
            assert k not in got
            continue
        r = got[k]
        assert (r.added, r.removed, r.changed) == (p - min(p, m), m - min(p, m), min(p, m))
        names = ["a", "b", "d", "n"]
        want = [c for i, c in enumerate(names) if [*plus][0][i + 1] != [*minus][0][i + 1]] if p == m == 1 else []
        assert r.changed_columns == want


def test_nested_maps_and_variants(spark):
    made = """SELECT id k, map('a', id, 'b', 2L) m, parse_json(concat('{"x":', id % 2, '}')) v,
              array(named_struct('p', map('z', -0.0D, 'y', CAST(NULL AS DOUBLE)))) s, array(1, NULL) q FROM range(20)"""
    cur = spark.sql(made)
    turned = spark.sql("""SELECT id k, map('b', 2L, 'a', id) m, parse_json(concat('{ "x" : ', id % 2, ' }')) v,
              array(named_struct('p', map('y', CAST(NULL AS DOUBLE), 'z', 0.0D))) s, array(1, NULL) q FROM range(20)""")
    assert snapshots.except_both(cur, turned).count() == 0
    prev = turned.withColumn("m", F.expr("IF(k = 3, map('a', 9L), m)")).withColumn("q", F.expr("IF(k = 4, array(NULL, 1), q)"))
    got = {r.k: r.changed_columns for r in snapshots.key_changes(cur, prev, ["k"]).collect()}
    assert got == {3: ["m"], 4: ["q"]}
    diff = snapshots.except_both(cur, prev).collect()
    assert sorted((r.side, r.k, r.m) for r in diff if r.k == 3) == [
        ("current_only", 3, {"a": 3, "b": 2}), ("previous_only", 3, {"a": 9})
    ]
    assert result_of(snapshots.compare_snapshots(cur, prev, ["k"])).violations == 2


def test_types_are_aligned(frame):
    a, b = frame([(1, 2)], "k int, v int"), frame([(2, 1)], "v bigint, k bigint")
    assert snapshots.except_both(a, b).count() == 0


def test_first_phase_shuffles_no_wide_column(spark):
    cur = spark.range(1000).select("id", F.repeat(F.lit("x"), 500).alias("wide"))
    prev = cur.withColumn("wide", F.expr("IF(id = 7, 'y', wide)"))
    plan = snapshots.net_hashes(cur, prev, ["id"])._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange hashpartitioning") :].splitlines()
    assert "wide" not in exchange[0] and "wide" not in exchange[1]
    made = snapshots.except_both(cur, prev)
    assert made.count() == 2
    rows = made._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in rows and "might_contain" not in rows


def test_bitmaps_let_wanted_rows_through_only(spark):
    df = spark.range(20000).select("id", F.concat(F.lit("row "), "id").alias("text"))
    wanted = snapshots.with_row_hash(df.filter("id % 1000 = 3"), df.columns).withColumn("_net", F.lit(1))
    got = snapshots.fetched(df, df.columns, wanted)
    assert {r.id for r in got.collect()} == set(range(3, 20000, 1000))


@pytest.mark.parametrize("seed", [6, 7])
def test_changed_columns_by_hash_and_by_row(frame, seed):
    rng = random.Random(seed)
    cur = [(i, *r[1:]) for i, r in enumerate(table(rng, 150))]
    prev = [(r[0], *[rng.choice([v, v, v, w]) for v, w in zip(r[1:], o[1:])]) for r, o in zip(cur, table(rng, 150))]
    cur += [(3, "x", "x", float("nan"), 1), (4, None, "42", -0.0, 42), (900, "a", "b", 1.0, None)]
    prev += [(3, "x", "x", float("nan"), 1), (5, None, "42", 0.0, 42), (900, "b", "a", 1.0, 42)]
    sides = [frame(rows, SCHEMA) for rows in (cur, prev)]
    by_hash, by_row = [
        sorted(map(tuple, snapshots.key_changes(*sides, ["k"], hashed_columns=n).collect()), key=str) for n in (16, 0)
    ]
    assert by_hash == by_row and (900, 0, 0, 1, ["a", "b", "n"]) in by_hash


def test_key_changes_of_few_columns_read_each_table_once(spark, tmp_path):
    for name in ("cur", "prev"):
        spark.range(100).select("id", (F.col("id") % 7).alias("v")).write.parquet(str(tmp_path / name))
    cur, prev = [spark.read.parquet(str(tmp_path / name)) for name in ("cur", "prev")]
    found = snapshots.key_changes(cur, prev.withColumn("v", F.expr("IF(id = 3, 9, v)")), ["id"])
    assert [tuple(r) for r in found.collect()] == [(3, 0, 0, 1, ["v"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("== Initial Plan ==")].count("FileScan") == 2


def test_names_of_changes_are_put_together_without_a_lambda(frame):
    cur, prev = frame([(1, 2, "x"), (2, 2, None)], "k int, n int, a string"), frame([(1, 3, "x"), (2, None, "y")], "k int, n int, a string")
    found = snapshots.key_changes(cur, prev, ["k"])
    missing = uncovered_rows(cur, [(["n"], prev, ["n"]), (["a"], prev, ["a"])])
    assert sorted((r.k, r.changed_columns) for r in found.collect()) == [(1, ["n"]), (2, ["n", "a"])]
    assert sorted((r.k, r.missing) for r in missing.collect()) == [(1, ["n"]), (2, ["n", "a"])]
    for df in (found, missing):
        assert "lambda" not in df._jdf.queryExecution().executedPlan().toString()
