"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tablecheck.llm import collocations as c

SCHEMA = "text string, lang string, id long, n int, a string, route int"
LOWER = str.maketrans({chr(x): chr(x + 32) for x in range(65, 91)})


def brute(rows, least, top, share=100):
    f, totals = {}, Counter()
    for text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            mine = f.setdefault(lang or "und", Counter())
            totals[lang or "und"] += len(words)
            for k in range(1, 6):
                mine.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            cuts = [(1000 * a * totals[lang] // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = [
                b for q, b in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if not any(100 * b >= share * a for b in inside):
                found.append((-score, -a, " ".join(p).encode(), often[p[:k]], often[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def talk(seed, n, words):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)] + ["É", "THE", "a\x1fb", "x y", "\xff", "<0>"]
    ends = [" ", "  ", "\t", " ", " ", " ", ". ", "\n", "\r", ", ", "!?"]
    fixed = "Once Upon a time there was"
    rows = []
    for i in range(n):
        text = "".join(rng.choice(pool) + rng.choice(ends) for _ in range(rng.randrange(40)))
        if rng.random() < 0.5:
            text += fixed + rng.choice(ends) + text
        rows.append((text, rng.choice(["en", "en", None, "de"]), i, 1, "x", 2))
    return rows + [(None, "en", 0, 1, "x", 2), ("", None, 0, 1, "x", 2), ("...\n \t", "fr", 0, 1, "x", 2)]


@pytest.mark.parametrize(
    "options", [{}, {"dictionary": 5}, {"route": 3}, {"dictionary": 5, "route": 20}, {"share": 60}], ids=str
)
def test_random_texts(frame, options):
    rows = talk(3, 300, 12)
    got = c.collocations(frame(rows, SCHEMA), least=6, top=50, **options).collect()
    assert sorted(map(tuple, got)) == brute(rows, 6, 50, options.get("share", 100))


def test_one_passage_and_one_pair_in_a_third_of_all_words(frame):
    """Routes that hold too much are routed on, and nothing is lost."""
    rng = random.Random(4)
    rows = [("same old line again " * 300, "en", i, 1, "x", 2) for i in range(3)]
    rows += [(" ".join(f"of the {rng.choice('abcdef')} {rng.choice('ghij')} {rng.choice('klm')}" for _ in range(300)), "en", 9, 1, "x", 2)]
    got = c.collocations(frame(rows, SCHEMA), least=4, top=500, route=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 500)


def test_empty(frame):
    assert c.collocations(frame([], SCHEMA)).collect() == []
    assert c.collocations(frame([(None, None, 1, 1, "x", 2)], SCHEMA)).collect() == []


def test_three_way_counts_every_prefix():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 4, (500, 5))
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
    counts = rng.integers(1, 4, 500)
    want = Counter()
    for row, n in zip(rows.tolist(), counts.tolist()):
        for d in range(1, 6):
            if row[d - 1]:
                want[tuple(row[:d])] += n
    found = c.three_way(rows, counts, 8, 2)
    got = {tuple(p.tolist()): n for part in found.values() for p, n in part}
    assert got == {p: n for p, n in want.items() if n >= 8 and len(p) > 1}


@pytest.mark.parametrize("low, high", [(0, 3), (0, 1 << 20), (-(2**62), 2**62)])
def test_packets_round_trip(low, high):
    rng = np.random.default_rng(2)
    rows = rng.integers(low, high, (3000, 5))
    rows[:, :2] = rng.choice([low + 1, high - 1, 1], (3000, 2))
    rows[rng.random((3000, 5)) < 0.1] = 0
    rows[:, 0] |= 1
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
    rows, counts = c.combined(rows, rng.choice([1, 1, 1, 7, 2**40], 3000))
    assert (c.unpacked(c.packed(rows, counts)) == np.column_stack([rows, counts])).all()
    assert c.unpacked(c.packed(rows[:1], counts[:1])).shape == (1, 6)


def test_hash_of_a_word_is_that_of_spark(frame):
    df = frame([("en", "wörd"), ("und", "x")], "lang string, word string")
    for r in df.select("lang", "word", c.hashed(7).alias("id")).collect():
        assert r.id == c.word_hash(r.lang, r.word.encode(), 7) < 0


def test_long_text(frame):
    text = "a long text. " * 400_000
    rows = [(text, "en", 1, 1, "x", 2), ("a long text", "en", 2, 1, "x", 2)]
    got = c.collocations(frame(rows, SCHEMA)).collect()
    assert [(r.phrase, r.a) for r in got] == [("a long text", 400_001)]
