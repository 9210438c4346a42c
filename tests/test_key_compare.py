"""Tables side by side when keys repeat or are null."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tablecheck.operators.joins import key_compare

SCHEMA = "k int, v double"


def expected_counts(left, right):
    """Per key: how many rows are same, differ or stand alone."""
    out = {}
    for key in {r[0] for r in left + right}:
        a = Counter(r[1] for r in left if r[0] == key)
        b = Counter(r[1] for r in right if r[0] == key)
        same = sum((a & b).values())
        l, r = sum(a.values()) - same, sum(b.values()) - same
        for side, n in (("same", same), ("differs", min(l, r)), ("left", l - min(l, r)), ("right", r - min(l, r))):
            if n:
                out[key, side] = n
    return out


def check(frame, left, right, **sizes):
    got = key_compare(frame(left, SCHEMA), frame(right, SCHEMA), ["k"], ["v"], **sizes).collect()
    assert Counter((r.k, r.side) for r in got) == Counter(expected_counts(left, right))
    # Every row of either side is in exactly one row of the result.
    assert Counter((r.k, r.v_left) for r in got if r.side != "right") == Counter(left)
    assert Counter((r.k, r.v_right) for r in got if r.side != "left") == Counter(right)
    assert all((r.v_left == r.v_right) == (r.side == "same") for r in got if r.side in ("same", "differs"))


def test_fifty_null_keys_are_no_all_pairs(spark, frame):
    left = [(None, float(i)) for i in range(50)]
    check(frame, left, [(None, float(i + 25)) for i in range(50)])


@pytest.mark.parametrize(
    "left, right",
    [([], []), ([(1, 1.0)], []), ([], [(1, None)]), ([(1, None)], [(1, None)]), ([(1, 1.0)] * 3, [(1, 1.0), (1, None)])],
)
def test_small_cases(spark, frame, left, right):
    check(frame, left, right)


def test_hot_key_in_buckets(spark, frame):
    left = [(7, float(i % 90)) for i in range(400)] + [(i, 1.0) for i in range(20)] + [(7, -1.0)] * 300
    right = [(7, float(i % 70) + 0.5) for i in range(350)] + [(i, 1.0 + i % 2) for i in range(20)] + [(7, 3.0)]
    check(frame, left, right, hot_rows=50, bucket_rows=16)


def test_more_copies_than_one_step(spark, frame):
    many = frame([(1, 1.0)], SCHEMA).crossJoin(spark.range(25_001)).drop("id")
    got = key_compare(many, frame([(1, 1.0), (1, 2.0)], SCHEMA), ["k"], ["v"])
    assert {r.side: r["count"] for r in got.groupBy("side").count().collect()} == {"same": 1, "differs": 1, "left": 24_999}


def test_clashing_names(spark, frame):
    df = frame([(1, 2.0)], "side int, n double")
    assert key_compare(df, df, ["side"], ["n"]).toDF("k", "s", "a", "b").collect() == [(1, "same", 2.0, 2.0)]


rows = st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, 0.0, 1.0, 2.0])), max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows, rows)
def test_any_rows(spark, frame, left, right):
    check(frame, left, right)
