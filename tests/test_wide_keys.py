"""Uniqueness of long keys by hash, and running costs by ranges, against plain counting."""

import random
from collections import Counter

import pytest
from single_row import result_of
from pyspark.sql import functions as F

from tablecheck.operators import integrity, rowhash
from tablecheck.plans import budget


def numbers(df, keys):
    r = result_of(integrity.check_unique(df, keys))
    return r.violations, int(r.metrics["total_duplicates"]), int(r.metrics["total_rows"])


@pytest.mark.parametrize("seed, n", [(1, 0), (2, 1), (3, 500)])
def test_long_keys(frame, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([None, "", "x" * 300, f"text {rng.randrange(200)}"]), rng.choice([None, 1, 2])) for _ in range(n)]
    df = frame(rows, "t string, i int")
    for keys, groups in ((["t"], Counter(r[0] for r in rows)), (["t", "i"], Counter(rows))):
        dups = {k: c for k, c in groups.items() if c > 1}
        assert numbers(df, keys) == (len(dups), sum(dups.values()), n)
        got = {tuple(r)[:-1] if len(keys) > 1 else r[0]: r.duplicate_count for r in integrity.duplicate_groups(df, keys).collect()}
        assert got == dups
        assert integrity.duplicate_rows(df, keys).count() == sum(dups.values())


def test_maps_and_variants_as_keys(spark):
    df = spark.sql("SELECT IF(id % 2 = 0, map('a', 1, 'b', 2), map('b', 2, 'a', 1)) m, parse_json(CAST(id % 3 AS STRING)) v FROM range(9)")
    assert numbers(df, ["m"]) == (1, 9, 9)
    assert numbers(df, ["m", "v"]) == (3, 9, 9)


def test_colliding_hashes_are_looked_at(frame, monkeypatch):
    """With a hash that tells nothing the answer is the same."""
    blind = lambda df, columns: df.withColumns({h: F.lit(1).cast("bigint") for h in rowhash.HASH})
    monkeypatch.setattr(integrity, "with_row_hash", blind)
    df = frame([("a",), ("b",), ("b",), (None,), (None,), ("c",)], "t string")
    assert numbers(df, ["t"]) == (2, 4, 6)


def test_no_unique_text_is_shuffled(spark):
    df = spark.range(3000).select(F.concat(F.repeat(F.lit("long "), 100), F.col("id") % 2990).alias("t"))
    made = integrity.key_group_sizes(df, ["t"])
    assert sum(r._rows for r in made.collect()) == 3000
    plan = made._jdf.queryExecution().executedPlan().toString()
    marked = integrity.suspects(df, ["t"], ["t"])
    assert marked.count() == 20 and "bitmap_construct_agg" in plan


def brute_costs(rows):
    rank = {"blocker": 1, "major": 2, "minor": 3}
    used, out = 0, {}
    for name, severity, size in sorted(rows, key=lambda r: (rank[r[1]], r[2], r[0])):
        used += size
        out[name] = used
    return out


@pytest.mark.parametrize("sizes", [[5], [0, 1, 7, 8, 1000, 10**12], list(range(300))])
def test_running_costs(frame, sizes):
    rng = random.Random(8)
    rows = [(f"{rng.choice('abcé')}{i}", rng.choice(["blocker", "major", "minor"]), rng.choice(sizes)) for i in range(400)]
    plan = frame([(*r, 0.5) for r in rows], "test string, severity string, scan_bytes bigint, seconds double")
    out = budget.running_costs(plan)
    got = {r.test: (r.used_bytes, r.used_seconds) for r in out.collect()}
    want = brute_costs(rows)
    order = sorted(want.values())
    assert {k: v[0] for k, v in got.items()} == want
    if len(set(order)) == len(order):
        assert all(v[1] == 0.5 * (order.index(v[0]) + 1) for v in got.values())


def test_no_window_over_the_whole_plan(frame):
    plan = frame([("a", "major", 1, 0.0)], "test string, severity string, scan_bytes bigint, seconds double")
    made = budget.check_budget(plan, scan_bytes=5)
    assert made.count() == 1
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in text
    assert "SinglePartition" not in text.split("Subquery")[0]
