"""Prefix tries against a plain dictionary of prefixes."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tablecheck.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, part string, key string, lender int"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            name = f"{len(role or '')}:{role or ''}{text or ''}".encode()
            tie = hashlib.sha256(name).digest()[:16]
            own[conv].append(((turn is not None, turn or 0), role or "", tie, text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - int(math.fmod(c, 5))  # towards zero, as in SQL
        made[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        bytes_ = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[c] for c in below) or 1
        saved[node] = (len(members[node]) - 1) * bytes_ + sum(saved[c] for c in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def answer(rows, frame):
    got = tries.prefix_trie(tries.rebuilt(frame)).select(tries.COLUMNS).collect()
    return sorted(map(tuple, got), key=str)


def clash(rows):
    return [(*r, "a", "b", 3) for r in rows]


def test_edges(frame):
    rows = [
        (0, None, "user", "first"),
        (0, 0, None, "zero"),
        (0, 0, "user", None),
        (0, 0, "user", None),
        (0, 1, "user", ""),
        (0, 1, "assistant", "ü" * 3000),
        (1, 5, "user", "x"),
        (3, 1, "user", "x"),
        (7, 1, "user", "same"),
        (7, 2, "assistant", "same"),
        (8, 1, "user", "same"),
        (8, 2, "assistant", "same"),
        (8, 2, "assistant", "same"),
        (None, 0, "user", "lost"),
        (-3, 0, "user", "same"),
        (10, None, None, None),
    ]
    assert answer(rows, frame(clash(rows), SCHEMA)) == brute(rows)


def test_empty(frame):
    assert answer([], frame([], SCHEMA)) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_talks(frame, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(400):
        for t in range(rng.choice([1, 2, 3, 9, 12, 30])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé"]) if t > 1 else "open"))
    rng.shuffle(rows)
    assert answer(rows, frame(clash(rows), SCHEMA)) == brute(rows)


def test_copies_fill_several_shards(frame):
    rows = [(5 * c, t, "user", f"line {t}") for c in range(600) for t in range(4)]
    rows += [(5 * c, 4, "user", f"end {c % 7}") for c in range(0, 600, 3)]
    assert answer(rows, frame(clash(rows), SCHEMA)) == brute(rows)


def test_one_long_conversation(frame):
    rows = [(0, t, "user", f"turn {t % 50}") for t in range(6000)]
    rows += [(10, t, "user", f"turn {t % 50}") for t in range(5990)]
    rows += [(c, t, "user", f"turn {t}") for c in range(20, 200, 5) for t in range(c % 7)]
    assert answer(rows, frame(clash(rows), SCHEMA)) == brute(rows)


def test_shares_of_shards_add_up(spark, frame):
    """Every cut of the same rows into shards gives the same nodes."""
    rows = [(5 * c, t, "user", f"{c % (3 ** t)}") for c in range(300) for t in range(5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in (1, 2, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(answer(rows, frame(clash(rows), SCHEMA)))
        assert all(f == brute(rows) for f in found)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
