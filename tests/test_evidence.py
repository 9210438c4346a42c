import datetime as dt

import pytest
from single_row import result_of

from tablecheck.functions.hashing import checksum, fast_checksum
from tablecheck.operators import evidence as E

WINDOW = E.EvidenceWindow("ts", "2024-01-01 00:00:00", "2024-01-02 00:00:00")


@pytest.fixture
def batch(frame):
    rows = [(i, i % 3, float(i), dt.datetime(2024, 1, 1, i)) for i in range(10)]
    rows.append((99, 0, 1000.0, dt.datetime(2024, 1, 2)))  # the end is outside
    return frame(rows, "id int, who int, amount double, ts timestamp_ntz")


def report(batch, manifest, tol=E.EvidenceTolerance()):
    return {r.metric: r for r in E.reconcile_evidence(batch, WINDOW, manifest, tol).collect()}


def test_exact(batch):
    m = E.Manifest("b", 10, {"SUM(amount)": 45, "DISTINCT(who)": 3, "MIN(ts)": "2024-01-01 00:00:00", "MAX_ts": "2024-01-01 09:00:00"})
    got = report(batch, m)
    assert set(got) == {"rowcount", "sum_amount", "distinct_who", "min_ts", "max_ts"}
    assert all(r.within for r in got.values())
    assert result_of(E.check_evidence(batch, WINDOW, m)).status == "pass"


@pytest.mark.parametrize(
    "expected, tol, within",
    [
        (11, E.EvidenceTolerance(), False),
        (11, E.EvidenceTolerance(rowcount_abs=1), True),
        (11, E.EvidenceTolerance(rowcount_pct=10.0), True),
        (11, E.EvidenceTolerance(rowcount_pct=9.0), False),
        (0, E.EvidenceTolerance(rowcount_pct=100.0), False),
        (0, E.EvidenceTolerance(rowcount_abs=10), True),
    ],
)
def test_rowcount(batch, expected, tol, within):
    assert report(batch, E.Manifest("b", expected), tol)["rowcount"].within is within


@pytest.mark.parametrize(
    "key, expected, within",
    [
        ("SUM(amount)", 45.2, True),
        ("SUM(amount)", 46, False),
        ("SUM(amount)", 0, False),
        ("SUM(amount)", None, False),
        ("MAX(ts)", "2024-01-01 09:00:01", False),
        ("MAX(ts)", "not a time", False),
        ("count_if(who = 0)", 4, True),
        ("count_if(who = 7)", 0, True),
    ],
)
def test_totals(batch, key, expected, within):
    got = report(batch, E.Manifest("b", 10, {key: expected}))
    assert got[E.total_name(key)].within is within


def test_empty_window_fails(batch):
    w = E.EvidenceWindow("ts", "2030-01-01", "2030-01-02")
    rows = E.reconcile_evidence(batch, w, E.Manifest("b", 10, {"SUM(amount)": 1})).collect()
    assert not any(r.within for r in rows)


def test_batches(frame):
    df = frame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 1.0)], "batch string, v double")
    manifests = frame([("a", 2, 3.0), ("b", 1, 9.0), ("d", 1, 1.0)], "batch_id string, rowcount bigint, sum_v double")
    rows = E.reconcile_batches(df, "batch", manifests, ["SUM(v)"]).collect()
    got = {(r.batch_id, r.metric): r.within for r in rows}
    assert got == {
        ("a", "rowcount"): True, ("a", "sum_v"): True, ("b", "rowcount"): True, ("b", "sum_v"): False,
        ("c", "rowcount"): False, ("c", "sum_v"): False, ("d", "rowcount"): False, ("d", "sum_v"): False,
    }


def test_keys(frame):
    df = frame([(1,), (2,), (2,), (None,)], "id int")
    sample = frame([("1",), ("3",), ("3",)], "key string")
    assert [r.key for r in E.missing_evidence_keys(df, "id", sample).collect()] == ["3"]
    from hashlib import sha256

    hashed = frame([(sha256(b"2").hexdigest(),), ("0" * 64,)], "key string")
    assert result_of(E.check_evidence_keys(df, "id", hashed, masked=True)).violations == 1


def test_contract(frame):
    df = frame([(1, '{"a":1}'), (None, '{"a":"x"}'), (3, "{}")], "id int, payload string")
    r = result_of(E.check_evidence_contract(df, fields=[("id", "NUMBER", None), ("z", "STRING", None)], payload="payload", paths={"$.a": "NUMBER"}, keys=["id"]))
    assert r.violations == 1 + 1 + 1 + 1


def test_checksum_is_order_free_and_sees_copies(frame):
    rows = [(1, "a"), (2, None), (3, "")]
    a = frame(rows, "i int, s string")
    b = frame(rows[::-1], "i int, s string").repartition(3)
    for fn in (checksum, fast_checksum):
        one = a.agg(fn(["i", "s"]).alias("c")).first().c
        assert one == b.agg(fn(["i", "s"]).alias("c")).first().c
        twice = a.unionByName(a).unionByName(a).agg(fn(["i", "s"]).alias("c")).first().c
        assert twice != one
        other = frame([(1, "a"), (2, ""), (3, None)], "i int, s string")
        assert other.agg(fn(["i", "s"]).alias("c")).first().c != one
    want = a.agg(checksum(["i", "s"]).alias("c")).first().c
    assert result_of(E.check_evidence_checksum(a, None, ["i", "s"], want)).status == "pass"


def test_separator_cannot_shift_values(frame):
    a = frame([("x|y", "z")], "a string, b string").agg(checksum(["a", "b"]).alias("c")).first().c
    b = frame([("x", "y|z")], "a string, b string").agg(checksum(["a", "b"]).alias("c")).first().c
    assert a != b
