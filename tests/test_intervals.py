import datetime as dt
import random

import pytest
from single_row import result_of
from pyspark.sql import functions as F

from tablecheck.operators import intervals

DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k int, f timestamp_ntz, t timestamp_ntz"


def day(n):
    return None if n is None else T0 + n * DAY


@pytest.mark.parametrize(
    "rows, overlaps, gaps, inverted, multi",
    [
        ([(0, 5), (5, None)], 0, 0, 0, 0),
        ([(0, 5), (7, None)], 0, 1, 0, 0),
        ([(0, 9), (5, None)], 1, 0, 0, 0),
        ([(0, None), (5, None)], 1, 0, 0, 1),
        ([(3, 3)], 0, 0, 1, 0),
        ([(0, 5), (0, 5)], 1, 0, 0, 0),
        ([(0, 100), (1, 2), (3, 4)], 2, 0, 0, 0),
        ([], 0, 0, 0, 0),
    ],
)
def test_scd2(frame, rows, overlaps, gaps, inverted, multi):
    df = frame([(1, day(a), day(b)) for a, b in rows], SCHEMA)
    for cuts in ({}, {"hot_rows": 1, "bucket_rows": 1}):
        r = result_of(intervals.check_scd2(df, "k", "f", "t", **cuts))
        m = r.metrics
        got = [int(m[x]) for x in ("overlaps", "gaps", "inverted", "keys_with_several_open_rows")]
        assert got == [overlaps, gaps, inverted, multi]
        assert r.violations == sum(got)


def brute_scd2(rows):
    far = dt.datetime(9999, 1, 1)
    out = {"overlaps": 0, "gaps": 0, "inverted": 0, "multi": 0}
    for k in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or far) for r in rows if r[0] == k)
        prior = None
        for f, t in own:
            out["overlaps"] += prior is not None and prior > f
            out["gaps"] += prior is not None and prior < f
            out["inverted"] += f >= t
            prior = t if prior is None else max(prior, t)
        out["multi"] += sum(r[2] is None for r in rows if r[0] == k) > 1
    return out


def test_scd2_hot_key_against_brute_force(frame):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        k = 0 if i % 3 == 0 else rnd.randrange(40)
        f = T0 + rnd.randrange(900) * DAY
        rows.append((k, f, None if rnd.random() < 0.02 else f + rnd.randrange(1, 60) * DAY))
    rows += [rows[0]] * 50  # a group of copies
    want = brute_scd2(rows)
    for cuts in ({}, {"hot_rows": 10, "bucket_rows": 20}, {"hot_rows": 100, "bucket_rows": 3}):
        r = result_of(intervals.check_scd2(frame(rows, SCHEMA), "k", "f", "t", **cuts))
        got = {x: int(r.metrics[x]) for x in ("overlaps", "gaps", "inverted")}
        assert got | {"multi": int(r.metrics["keys_with_several_open_rows"])} == want


def test_scd2_current_flag_and_null_start(frame):
    df = frame(
        [(1, day(0), day(5), False), (1, day(5), day(900), True), (1, None, day(3), True)],
        SCHEMA + ", cur boolean",
    )
    r = result_of(intervals.check_scd2(df, "k", "f", "t", current="cur"))
    assert r.metrics["keys_with_several_open_rows"] == "1"
    assert r.metrics["inverted"] == "1"


@pytest.mark.parametrize("hot, bucket", [(10_000, 1), (5, 1), (100, 7), (30, 1000)])
def test_running_max_any_cut(frame, hot, bucket):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", T0 + rnd.randrange(200) * dt.timedelta(minutes=1)) for i in range(300)]
    df = frame(rows, "i int, s string, ts timestamp_ntz")
    out = intervals.behind_running_max(df, "ts", "i", "s", sla_seconds=600, hot_rows=hot, bucket_rows=bucket)
    got = {r.i for r in out.filter("late").collect()}
    want, newest = set(), {}
    for i, s, ts in rows:
        if s in newest and newest[s] - ts > dt.timedelta(minutes=10):
            want.add(i)
        newest[s] = max(newest.get(s, ts), ts)
    assert got == want
    assert out.count() == len(rows)


@pytest.mark.parametrize("shape", ["outlier", "equal positions", "copies"])
def test_no_bucket_holds_twice_its_rows(spark, shape):
    n, size = 40_000, 1000
    at = {"outlier": "id + IF(id = 7, 1000000000000000, 0)", "equal positions": "id % 3", "copies": "1"}[shape]
    df = spark.range(n).select(
        F.lit("k").alias("k"), F.expr(at).alias("p"), (F.lit(5) if shape == "copies" else F.col("id")).alias("t")
    )
    df = df.unionByName(spark.range(50).select(F.lit("cold").alias("k"), F.col("id").alias("p"), F.col("id").alias("t")))
    cut = intervals.with_bucket(df, ["k"], "p", "t", 5000, size, split_copies=True).collect()
    sizes = {}
    for r in cut:
        assert r._hot == (r.k == "k")
        sizes.setdefault((r.k, r._bucket), []).append((r.p, r.t))
    hot = sorted((b, v) for (k, b), v in sizes.items() if k == "k")
    assert sum(len(v) for _, v in hot) == n and len(sizes) == len(hot) + 1
    assert max(len(v) for _, v in hot) <= 2 * size
    assert all(max(a) <= min(b) for (_, a), (_, b) in zip(hot, hot[1:]))


@pytest.mark.parametrize("bucket", [1, 20, 400])
def test_running_max_of_equal_positions(frame, bucket):
    """Copies and ties of one key in several buckets give what one window gives."""
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), "s", T0 + rnd.choice([0, 1, 1, 30]) * DAY) for _ in range(600)]
    rows += [(None, "s", T0 + 2 * DAY), (4, None, T0), (4, None, T0 - DAY), (2, "s", None)]
    df = frame(rows, "i int, s string, ts timestamp_ntz")
    want = [r.late for r in intervals.behind_running_max(df, "ts", "i", "s", 600).orderBy("s", "i", "ts", "late").collect()]
    out = intervals.behind_running_max(df, "ts", "i", "s", 600, hot_rows=1, bucket_rows=bucket)
    assert [r.late for r in out.orderBy("s", "i", "ts", "late").collect()] == want
    assert sum(want) > 50


def test_no_row_carries_all_cuts_of_its_key(spark):
    """Cuts are looked up in arrays of at most FAN (the topmost: one in FAN * FAN cuts)."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("p"), F.col("id").alias("t"))
    cuts = intervals.hot_cuts(df, ["k"], "p", "t", 10, 3).cache()
    count = cuts.select(F.size("_cuts")).first()[0]
    assert count > intervals.FAN * intervals.FAN
    for span in (intervals.FAN, 1):
        nodes = intervals.cut_nodes(cuts, ["_h_k"], span).collect()
        assert max(len(r._cuts) for r in nodes) == intervals.FAN
        assert sum(len(r._cuts) for r in nodes) == -(-count // span)
    sizes = intervals.with_bucket(df, ["k"], "p", "t", 10, 3).groupBy("_bucket")
    sizes = sizes.agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("p").alias("n")).orderBy("_bucket").collect()
    assert [r._bucket for r in sizes] == [i * intervals.PARTS for i in range(count + 1)]
    assert all(r.b - r.a + 1 == r.n <= 6 for r in sizes) and sum(r.n for r in sizes) == 20_000
    assert all(x.b + 1 == y.a for x, y in zip(sizes, sizes[1:]))


def test_only_the_largest_keys_are_cut(frame, monkeypatch):
    monkeypatch.setattr(intervals, "HOT_KEYS", 2)
    df = frame([(k,) for k in range(6) for _ in range(k + 3)], "k int")
    assert [(r._h_k, r._n) for r in intervals.hot_keys(df, ["k"], 4).collect()] == [(5, 8), (4, 7)]


def test_no_window_holds_a_whole_key(frame):
    """Every window over detail rows is partitioned by key AND bucket."""
    df = frame([(1, day(0), day(1))], SCHEMA)
    plan = intervals.interval_frame(df, "k", "f", "t")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "- Window [" in x]
    detail = [w for w in windows if "_row#" in w]
    assert len(detail) == 1 and "_bucket#" in detail[0].split("], [")[1]
    others = [w for w in windows if w not in detail]
    assert any("max(_max#" in w for w in others)
    assert all("max(_max#" in w or "sum(w#" in w or "lag(_" in w for w in others), "summaries and samples only"
    assert "partial_max(_end#" in plan, "buckets are reduced on the map side"


def test_late_rate(frame):
    rows = [(T0, T0 + dt.timedelta(seconds=s)) for s in (0, 300, 301, 4000)] + [(None, T0)]
    df = frame(rows, "e timestamp_ntz, a timestamp_ntz")
    r = result_of(intervals.check_late_arrivals(df, "e", "a", 300, 0.5))
    assert (r.status, r.observed, r.metrics["late_rows"]) == ("pass", 0.5, "2")
    assert result_of(intervals.check_late_arrivals(df, "e", "a", 300, 0.4)).violations == 2


def test_numeric_interval(frame):
    df = frame([("a", 0, 10), ("a", 10, 20), ("a", 25, None)], "k string, f int, t int")
    r = result_of(intervals.check_scd2(df, "k", "f", "t", hot_rows=1, bucket_rows=1))
    assert (r.metrics["gaps"], r.metrics["overlaps"]) == ("1", "0")
    assert df.select(F.count("k")).first()[0] == 3
