"""Multiprobe search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tablecheck.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, cid string, bucket int, vector string"


def brute(rows, asks, k=10):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = set()
    for i in ok:
        if not asks(i):
            continue
        found = []
        for j, vs in ok.items():
            pairs = [(a, b) for a in ok[i] for b in vs if len(a) == len(b)]
            if j != i and pairs:
                found.append((min(float(np.sqrt(((a - b) ** 2).sum())) for a, b in pairs), j))
        out |= {(i, rank + 1, j, round(d, 9)) for rank, (d, j) in enumerate(sorted(found)[:k])}
    return out


def answer(df, every, k=10):
    got = neighbours.nearest(df, F.col("vec_id") % every == 0, k).collect()
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got)
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got}


def recall(got, want):
    return len({g[::2][:2] for g in got} & {w[::2][:2] for w in want}) / len(want)


def test_edges(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]),
        (0, [1.0, 0.0]),
        (0, [0.0, 5.0]),
        (100, [1.0, 0.0]),
        (200, [0.0, 0.0]),
        (300, [nan, 1.0]),
        (400, [inf, 1.0]),
        (500, [None, 1.0]),
        (600, None),
        (700, []),
        (None, [1.0, 0.0]),
        (800, [1.0, 1.0, 1.0]),
        (900, [1.0, 2.0, 1.0]),
        (-100, [2.0, 0.0]),
        (3, [0.0, 2.0]),
    ]
    rows += [(i, [0.5, 0.5]) for i in range(1000, 1030)]
    df = frame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert answer(df, 100) == brute(rows, lambda i: i % 100 == 0)
    assert answer(df, 100, 3) == brute(rows, lambda i: i % 100 == 0, 3)


def test_empty(frame):
    assert answer(frame([], SCHEMA), 100) == set()


def test_one_vector_in_a_third_of_the_rows(frame):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2000)] + [(i, [1.0] * 8) for i in range(2000, 3000)]
    df = frame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got, want = answer(df, 50), brute(rows, lambda i: i % 50 == 0)
    assert len(got) == len(want) and recall(got, want) > 0.95
    assert {g for g in got if g[0] >= 2000} == {w for w in want if w[0] >= 2000}


def test_recall_among_clusters(frame):
    """Close clusters and far single points, which need a search of their own."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 10
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(6000)]
    rows += [(i, (rng.normal(size=16) * 200).tolist()) for i in range(6000, 6300, 50)]
    got = answer(frame([(*r, "x", 1, "y") for r in rows], SCHEMA), 50)
    want = brute(rows, lambda i: i % 50 == 0)
    assert len(got) == len(want) and recall(got, want) > 0.93
    assert {g for g in got if g[0] >= 6000} == {w for w in want if w[0] >= 6000}


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.op12(spark, folder).collect()}
    want = brute(rows, lambda i: i % 100 == 0)
    assert len(got) == len(want) and recall(got, want) >= 0.93


def test_visits_reach_the_asked_chance():
    """Share of made neighbours at the radius whose cell is visited."""
    rng = np.random.default_rng(7)
    hashing = neighbours.Hashing(2, 6, 1.0, 0.9)
    hits = 0
    for _ in range(400):
        a, step = rng.normal(size=32), rng.normal(size=32)
        b = a + step / np.linalg.norm(step)
        for t in range(2):
            pa_, pb = hashing.places(t, np.stack([a, b]))
            if (np.floor(pb) == hashing.visited(pa_, 1.0)).all(1).any():
                hits += 1
                break
    assert hits / 400 > 0.86
