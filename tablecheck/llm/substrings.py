"""Removal of long repeated byte strings.

A string of `length` bytes is repeated if it starts at two or more places of the
table. Positions are treated as intervals of strings with a common prefix, extended
breadth first by increasing length until `length`, and dropped once an interval holds
one position:

1. Each window of `length` bytes chooses an anchor, its least hash of GRAM bytes.
   Equal windows choose equal anchors at equal offsets. Neighbouring windows with one
   anchor form a segment, one per some 180 bytes; an interval is all segments with
   equal anchors. An anchor that occurs once ends there.
2. The intervals are extended to the segments' whole contexts. Where a context occurs
   again, all its windows are repeated.
3. Contexts that share an anchor but differ are compared window by window inside
   tasks that hold whole intervals; intervals too large for that are counted window
   by window in a shuffle.

Passages of words are found in the same way, with a hash for each word in place of
each byte, so their length in bytes does not matter.

No Burrows-Wheeler transform is built: see README.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import cut, query, table, text_key
from .shingles import BASE, mix, powers

LENGTH = 400
GRAM = 32
WORDS, WORD_GRAM = 51, 10
CHUNK = 1 << 20
LARGE_INTERVAL = 4096
BATCH_BYTES = 1 << 21

# Second base, and multipliers of the mixed keys.
BASE2 = 0xD1342543DE82EF95
A, D = 0x9FB21C651E98DF25, 0xDA942042E4DD58B5
_TABLES: dict[int, np.ndarray] = {BASE: np.ones(1, np.uint64)}


def _powers(base: int, n: int) -> np.ndarray:
    if base == BASE:
        return powers(n)
    have = _TABLES.get(base, np.ones(1, np.uint64))
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have)), base, np.uint64)
        steps[0] = 1
        have = _TABLES[base] = np.multiply.accumulate(steps)
    return have[:n]


class Rolling:
    """Hashes of any substring of `raw` in constant time."""

    def __init__(self, raw: np.ndarray, base: int) -> None:
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(base, n), out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte after it; words as in `base.WORD`."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    starts, ends = word_places(raw)
    out = np.zeros(len(starts), np.uint64)
    step = CHUNK // 8
    for begin in range(0, len(starts), step):
        lo, hi = starts[begin : begin + step], ends[begin : begin + step]
        part = Rolling(raw[lo[0] : hi[-1]], BASE)
        out[begin : begin + step] = mix(part(lo - lo[0], hi - lo[0]) + (hi - lo).astype(np.uint64) * np.uint64(D))
    return out


def _sequence(text: str | None, words: bool) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _word_hashes(raw) if words else raw


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` consecutive ones, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """anchor, two context hashes, first and last window start, anchor's offset from
    the first: arrays with one entry per segment."""
    out: list[list[np.ndarray]] = []
    for begin in range(0, max(len(raw) - length + 1, 0), CHUNK):
        part = raw[begin : begin + CHUNK + length - 1]
        one, two = Rolling(part, BASE), Rolling(part, BASE2)
        at = np.arange(len(part) - gram + 1)
        grams = mix(one(at, at + gram))
        low = np.uint64((1 << 21) - 1)
        least = _sliding_least((grams & ~low) | at.astype(np.uint64), length - gram + 1)
        place = (least & low).astype(np.int64)
        lo = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        hi = np.append(lo[1:], len(place)) - 1
        anchor = place[lo]
        shape = (anchor - lo).astype(np.uint64) * np.uint64(A) + (hi - lo).astype(np.uint64) * np.uint64(D)
        contexts = [mix(h(lo, hi + length) + shape) for h in (one, two)]
        out.append([grams[anchor], *contexts, lo + begin, hi + begin, anchor - lo])
    if not out:
        return [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)] * 3
    return [np.concatenate(c) for c in zip(*out)]


SEGMENT = "tk binary, anchor long, c1 long, c2 long, lo long, hi long, shift int"


def _segmented(length: int, gram: int, words: bool):
    names = ["tk", "anchor", "c1", "c2", "lo", "hi", "shift"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                keys, found = [], []
                for text in batch.column(0).slice(start, 256).to_pylist():
                    sequence = _sequence(text, words)
                    if len(sequence) >= length:
                        got = segments(sequence, length, gram)
                        keys += [hashlib.sha256(text.encode()).digest()[:16]] * len(got[0])
                        found.append(got)
                if found:
                    columns = [np.concatenate(c) for c in zip(*found)]
                    arrays = [pa.array(c.view(np.int64)) for c in columns[:5]]
                    arrays.append(pa.array(columns[5].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *arrays], names=names)

    return work


def _windows(rows: list[dict], length: int, words: bool) -> tuple[np.ndarray, ...]:
    """Two keys of every window of some contexts, the context's number and the
    window's place in it."""
    raw = np.frombuffer(b"".join(r["context"] for r in rows), np.uint64 if words else np.uint8)
    sizes = np.array([len(r["context"]) for r in rows]) // raw.itemsize
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(rows)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[owner] + place
    anchor = np.array([r["anchor"] for r in rows], np.int64).view(np.uint64)[owner]
    back = (np.array([r["shift"] for r in rows], np.int64)[owner] - place).view(np.uint64)
    shape = anchor * np.uint64(A) + back * np.uint64(D)
    keys = [mix(Rolling(raw, base)(start, start + length) + shape) for base in (BASE, BASE2)]
    return keys[0], keys[1], owner, place


def _runs(rows: list[dict], owner: np.ndarray, place: np.ndarray) -> list[tuple[bytes, int, int]]:
    """Consecutive places of one context as (tk, first start, last start)."""
    if not len(owner):
        return []
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return [
        (rows[o]["tk"], rows[o]["lo"] + int(a), rows[o]["lo"] + int(b))
        for o, a, b in zip(owner[first], place[first], place[last])
    ]


def _marks(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    kinds = [pa.binary(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["tk", "lo", "hi"])


def _solved(length: int, words: bool):
    """Repeated windows of contexts that occur once. Rows come ordered by anchor;
    whole intervals are taken together."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        one, two, owner, place = _windows(rows, length, words)
        weight = np.array([min(r["n"], 2) for r in rows])[owner]
        order = np.lexsort((two, one))
        one, two, owner, place, weight = (x[order] for x in (one, two, owner, place, weight))
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        group = np.cumsum(new) - 1
        repeated = np.bincount(group, weight)[group] >= 2
        single = np.array([r["n"] == 1 for r in rows])[owner]
        return _marks(_runs(rows, owner[repeated & single], place[repeated & single]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= BATCH_BYTES and r["anchor"] != held[-1]["anchor"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["context"])
        if held:
            yield solve(held)

    return work


def _counted(length: int, words: bool):
    """All windows of contexts as rows: k1, k2, n, tk, start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512).to_pylist()
                one, two, owner, place = _windows(rows, length, words)
                lo, n = (np.array([r[c] for r in rows], np.int64)[owner] for c in ("lo", "n"))
                tk = pa.array([r["tk"] for r in rows], pa.binary()).take(pa.array(owner))
                columns = [pa.array(x.view(np.int64)) for x in (one, two, n)] + [tk, pa.array(lo + place)]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "n", "tk", "lo"])

    return work


CONTEXT = "tk binary, anchor long, c1 long, c2 long, lo long, shift int, n long, m long, context binary"


def _contexts(length: int, words: bool):
    """The bytes, or hashes of words, of the wanted contexts of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                rows = []
                for r in batch.slice(start, 128).to_pylist():
                    sequence = _sequence(r["text"], words)
                    for w in r["wanted"]:
                        context = sequence[w["lo"] : w["hi"] + length].tobytes()
                        rows.append({"tk": r["tk"], **w, "context": context})
                names = [c.split()[0] for c in CONTEXT.split(", ")]
                kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
                types = [kinds[c.split()[1]] for c in CONTEXT.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names
                )

    return work


def repeated_windows(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    large_interval: int = LARGE_INTERVAL,
    words: bool = False,
) -> DataFrame:
    """(tk, lo, hi): runs of starts of repeated strings, per distinct text. With
    `words`, all lengths and places count words instead of bytes."""
    texts = docs.select("text")
    found = cut(texts.mapInArrow(_segmented(length, gram, words), SEGMENT))
    key = ["anchor", "c1", "c2"]
    contexts = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    anchors = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).where(
        F.col("all") > 1
    )
    info = contexts.join(anchors.drop("all"), "anchor")
    hits = cut(found.join(info, key), release=True)
    whole = hits.where("n > 1").select("tk", "lo", "hi").distinct()
    # One context of each kind is enough to compare with the others.
    unclear = hits.where("m > 1").dropDuplicates(key)
    wanted = unclear.groupBy("tk").agg(
        F.collect_list(F.struct("anchor", "c1", "c2", "lo", "hi", "shift", "n", "m")).alias("wanted")
    )
    source = docs.select(text_key(F.col("text")).alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    read = source.join(wanted, "tk").select("tk", "text", "wanted").mapInArrow(_contexts(length, words), CONTEXT)
    read = cut(read, release=True)
    small = read.where(F.col("m") <= large_interval).dropDuplicates(key)
    small = small.repartition("anchor").sortWithinPartitions("anchor")
    marks = whole.unionByName(small.mapInArrow(_solved(length, words), "tk binary, lo long, hi long"))
    large = read.where(F.col("m") > large_interval).dropDuplicates(key)
    rows = large.mapInArrow(_counted(length, words), "k1 long, k2 long, n long, tk binary, lo long")
    again = rows.groupBy("k1", "k2").agg(F.sum("n").alias("s")).where("s > 1").select("k1", "k2")
    spread = rows.where("n = 1").join(again, ["k1", "k2"]).select("tk", "lo", F.col("lo").alias("hi"))
    return cut(marks.unionByName(spread), release=True)


DIGESTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
CUTS = "n_cut long, n_cuts long, cut_text string"


def _added(keep_text: bool, apart: bool) -> str:
    """The columns that `remove_repeats` adds."""
    return DIGESTS + (f", {CUTS}" if apart else "") + (", kept_text string" if keep_text else "")


def _without(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left outside the ranges, and the number of runs that go."""
    kept, at = [], 0
    merged = _merged(ranges)
    for lo, hi in merged:
        kept.append(raw[at:lo])
        at = hi
    return b"".join([*kept, raw[at:]]), len(merged)


def _removed(length: int, words: int | None, keep_text: bool, apart: bool):
    columns = [c.split() for c in _added(keep_text, apart).split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in columns]

    def row(text: str | None, runs: list[dict]) -> tuple:
        raw = (text or "").encode()

        def left(some: list[dict]) -> tuple[bytes, int]:
            return _without(raw, _ranges(raw, some, length, words))

        def decoded(rest: bytes) -> str | None:
            return text if len(rest) == len(raw) else rest.decode(errors="ignore")

        first = [r for r in runs if not r["words"]] if apart else runs
        rest, spans = left(first)
        out = (len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest())
        if apart:
            less, cuts = left(runs) if len(first) < len(runs) else (rest, spans)
            out = (*out, len(raw) - len(less), cuts, decoded(less))
        return (*out, decoded(rest)) if keep_text else out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [row(t, r or []) for t, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                rest_columns = [part.column(i) for i in range(2, part.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*made, *rest_columns], names=[c for c, _ in columns] + part.schema.names[2:]
                )

    return work


def _ranges(raw: bytes, runs: list[dict], length: int, words: int | None) -> list[tuple[int, int]]:
    """Byte ranges covered by strings that start within the runs. A passage of words
    goes with the space up to the next word."""
    out = [(r["lo"], r["hi"] + length) for r in runs if not r["words"]]
    passages = [r for r in runs if r["words"]]
    if passages:
        starts = np.append(word_places(np.frombuffer(raw, np.uint8))[0], len(raw))
        out += [(int(starts[r["lo"]]), int(starts[r["hi"] + words])) for r in passages]
    return out


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(
    docs: DataFrame,
    keep: list[str] | None = None,
    length: int = LENGTH,
    gram: int = GRAM,
    large_interval: int = LARGE_INTERVAL,
    keep_text: bool = False,
    words: int | None = None,
    apart: bool = False,
) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept_sha256, with keep_text kept_text (code points
    that a cut splits are left out), and the columns `keep` of every row.

    A byte goes if it is covered by a string of `length` bytes that also starts
    elsewhere in the table, in the same text or another; all occurrences go. With
    `words`, so does every run of that many words that also starts elsewhere, whatever
    its bytes and the space between its words. With `apart`, these columns leave such
    runs in, and n_cut, n_cuts and cut_text follow: bytes and spans that go with the
    runs as well, and the text that is left then. Null
    text: empty. Repeated rows of at least `length` bytes repeat each other. Texts
    are compared as UTF-8 and never across rows. An empty table gives no rows.
    Columns of `keep` that share a name with an added one give way to it.
    """
    keep = ["doc_id"] if keep is None else keep
    if apart and not words:
        raise ValueError("apart needs a number of words")
    schema = _added(keep_text, apart)
    added = [c.split()[0] for c in schema.split(", ")]
    names = [c for c in keep if c not in added]
    marks = repeated_windows(docs, length, gram, large_interval).withColumn("words", F.lit(False))
    if words:
        passages = repeated_windows(docs, words, min(WORD_GRAM, words), large_interval, True)
        marks = marks.unionByName(passages.withColumn("words", F.lit(True)))
    runs = marks.groupBy("tk").agg(F.collect_list(F.struct("lo", "hi", "words")).alias("__runs"))
    kept = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(names)]
    source = docs.select(text_key(F.col("text")).alias("tk"), F.col("text").alias("__text"), *kept)
    joined = source.join(runs, "tk", "left").select("__text", "__runs", *[f"__k{i}" for i in range(len(names))])
    types = [docs.schema[c].dataType.simpleString() for c in names]
    schema += "".join(f", __k{i} {t}" for i, t in enumerate(types))
    out = joined.mapInArrow(_removed(length, words, keep_text, apart), schema)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(names)], *added)


@query("op8_suffix_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Strings of 400 bytes, and apart from them passages of over 50 words, which can
    have fewer bytes."""
    return remove_repeats(table(spark, folder, "documents"), words=WORDS, apart=True)
