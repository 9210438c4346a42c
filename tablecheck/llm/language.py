"""Language of texts by a linear-chain conditional random field over words.

Every word is described by its affixes, its letter n-grams and its place in a
lexicon, hashed into weights per language; learned transitions say how languages
follow each other, so that a text which switches languages is labelled word by word.
Forward-backward gives each word's distribution; a document's language is the one
with the largest mean over its words, and that mean is its score.

Training uses a bounded sample: at most SAMPLE documents of each label, those with
the least hash of doc_id. Their pieces are joined into sequences that switch
languages, from which the transitions are learned.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .base import query, table

SAMPLE = 300
MAX_LABELS = 64
BUCKETS = 1 << 15
SEQUENCES, STEPS, BATCH, RATE = 4000, 250, 64, 0.05
LEXICON_SHARE = 0.8
CACHE_WORDS = 400_000
NEW_WORDS = 10_000
GROUP_CELLS = 300_000
UNKNOWN = "und"
MIX, SHIFT = np.uint32(0x85EBCA6B), np.uint32(15)
WORD = re.compile(r"[^\W\d_]{1,64}")  # a longer run of letters is several words


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _mixed(codes: np.ndarray, kind: int) -> np.ndarray:
    """One bucket for each row of code points along the last axis; `kind` tells
    prefixes, suffixes and n-grams apart."""
    h = np.full(codes.shape[:-1], kind, np.uint32)
    for i in range(codes.shape[-1]):
        h = (h ^ codes[..., i]) * MIX
        h ^= h >> SHIFT
    return (h % np.uint32(BUCKETS)).astype(np.int32)


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """One row per word with the numbers of its features below BUCKETS, then one per
    lexicon; -1 where there is none."""
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    rows, width = np.arange(n)[:, None], int(lengths.max())
    padded = "".join("\0\0\0" + w.ljust(width + 3, "\0") for w in words).encode("utf-32-le")
    codes = np.frombuffer(padded, np.uint32).reshape(n, width + 6)
    edged = codes.copy()
    edged[:, 2], edged[rows[:, 0], lengths + 3] = ord("^"), ord("$")
    found = [np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int32, n)[:, None]]
    for size in (1, 2, 3):
        found.append(_mixed(codes[:, 3 : 3 + size], size)[:, None])
        found.append(_mixed(codes[rows, lengths[:, None] + np.arange(3 - size, 3)], 3 + size)[:, None])
    grams = _mixed(np.lib.stride_tricks.sliding_window_view(edged[:, 2 : width + 4], 3, axis=1), 7)
    found.append(np.where(np.arange(width) < lengths[:, None], grams, -1))
    listed = np.fromiter((lexicon.get(w, -1) for w in words), np.int32, n)
    found.append(np.where(listed < 0, -1, listed + BUCKETS)[:, None])
    return np.concatenate(found, axis=1)


def forward_backward(emit: np.ndarray, move: np.ndarray, mask: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, t, labels) and summed pair marginals (labels, labels; zeros
    without `count`) for scores `emit`, transition scores `move` and a mask of words,
    which lie at the front of each row."""
    n, steps, labels = emit.shape
    emit, mask = np.ascontiguousarray(emit.transpose(1, 0, 2)), mask.T
    e, m = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(move)
    whole = mask.all(axis=1)
    ahead, scale = np.empty_like(e), np.ones((steps, n, 1))
    for t in range(steps):
        now = ahead[t - 1] @ m * e[t] if t else e[t] / labels
        now /= (total := now @ np.ones((labels, 1)))
        if t and not whole[t]:
            now, total = np.where(mask[t, :, None], now, ahead[t - 1]), np.where(mask[t, :, None], total, 1)
        ahead[t], scale[t] = now, total
    behind = np.ones((n, labels))
    marginal, pairs = ahead, np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        before = ahead[t - 1].copy() if t and count else None
        marginal[t] *= behind
        if t:
            right = e[t] * behind / scale[t]
            if count:
                used = mask[t]
                pairs += m * (before[used].T @ right[used])
            right = right @ m.T
            behind = right if whole[t] else np.where(mask[t, :, None], right, behind)
    marginal /= marginal.sum(axis=2, keepdims=True)
    return marginal.transpose(1, 0, 2), pairs


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, int], weights: np.ndarray, move: np.ndarray) -> None:
        self.labels, self.lexicon, self.weights, self.move = labels, lexicon, weights, move

    def scores(self, words: list[str]) -> np.ndarray:
        """One row of label scores for each word."""
        found = features(words, self.lexicon)
        total = np.zeros((len(words), len(self.labels)))
        for at in range(found.shape[1]):
            here = found[:, at]
            total += np.where(here[:, None] < 0, 0, self.weights[here])
        return total


def _sequences(docs: list[tuple[list[str], int]], rng: np.random.Generator) -> list[list[tuple[str, int]]]:
    out = []
    for _ in range(SEQUENCES):
        sequence: list[tuple[str, int]] = []
        for _ in range(rng.integers(1, 4)):
            words, label = docs[rng.integers(len(docs))]
            start = int(rng.integers(max(1, len(words) - 4)))
            sequence += [(w, label) for w in words[start : start + int(rng.integers(4, 25))]]
        out.append(sequence)
    return out


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, label) rows; labels in order of their names."""
    labels = sorted({label for _, label in rows})
    at = {label: i for i, label in enumerate(labels)}
    docs = [(words_of(t), at[label]) for t, label in rows]
    docs = [d for d in docs if d[0]]
    counts: dict[str, Counter] = {}
    for words, label in docs:
        for w in words:
            counts.setdefault(w, Counter())[label] += 1
    lexicon = {}
    for w, c in counts.items():
        label, n = c.most_common(1)[0]
        if n > 1 and n >= LEXICON_SHARE * c.total():
            lexicon[w] = label
    rng = np.random.default_rng(seed)
    size, k = BUCKETS + len(labels), len(labels)
    weights, move = np.zeros((size, k)), np.zeros((k, k))
    if not docs or k < 2:
        return Model(labels, lexicon, weights, move)
    # Documents of each label are drawn alike, however many there are.
    by_label = [[d for d in docs if d[1] == i] for i in range(k)]
    docs = [by_label[i % k][i // k % len(by_label[i % k])] for i in range(k * SAMPLE) if by_label[i % k]]
    sequences = _sequences(docs, rng)
    words = sorted({w for sequence in sequences for w, _ in sequence})
    known = {w: f[f >= 0] for w, f in zip(words, features(words, lexicon))}
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, move)]
    for step in range(1, STEPS + 1):
        batch = [sequences[i] for i in rng.integers(len(sequences), size=BATCH)]
        grads = _gradient(batch, weights, move, known)
        for p, g, (m, v) in zip((weights, move), grads, state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(labels, lexicon, weights, move)


def _gradient(batch, weights, move, known) -> tuple[np.ndarray, np.ndarray]:
    k, steps = move.shape[0], max(len(s) for s in batch)
    mask = np.zeros((len(batch), steps), bool)
    truth = np.zeros((len(batch), steps, k))
    flat, owner = [], []
    for i, sequence in enumerate(batch):
        for t, (w, label) in enumerate(sequence):
            flat.append(known[w])
            owner.append(i * steps + t)
            mask[i, t], truth[i, t, label] = True, 1
    owner = np.repeat(owner, [len(f) for f in flat])
    flat = np.concatenate(flat)
    cells = len(batch) * steps
    emit = np.stack([np.bincount(owner, weights[flat, j], cells) for j in range(k)], axis=1).reshape(-1, steps, k)
    marginal, pairs = forward_backward(emit, move, mask)
    miss = ((truth - marginal) * mask[:, :, None]).reshape(-1, k)
    by_feature = np.stack([np.bincount(flat, miss[owner, j], len(weights)) for j in range(k)], axis=1)
    seen = np.einsum("nta,ntb->ab", truth[:, :-1], truth[:, 1:])
    words = mask.sum()
    return by_feature / words - 1e-6 * weights, (seen - pairs) / words


def sample_rows(docs: DataFrame, per_label: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, label) of at most per_label documents of each label."""
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    labels = [r["lang"] for r in usable.select("lang").distinct().limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    ids: set[int] = set()
    order = F.xxhash64("doc_id")
    for label in labels:
        part = usable.where(F.col("lang") == label).select("doc_id").distinct().orderBy(order, "doc_id").limit(per_label)
        ids |= {r["doc_id"] for r in part.collect()}
    chosen = usable.where(F.col("doc_id").isin(sorted(ids))).groupBy("doc_id")
    rows = chosen.agg(F.min(F.struct("text", "lang")).alias("r")).orderBy("doc_id").collect()
    return [(r["r"]["text"], r["r"]["lang"]) for r in rows]


def _labelled(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table_ = np.zeros((1024, len(model.labels)))

        def numbers(words: list[str]) -> list[int]:
            nonlocal table_
            fresh = sorted(set(words).difference(known), key=len)
            for at in range(0, len(fresh), NEW_WORDS):
                part = fresh[at : at + NEW_WORDS]
                while len(known) + len(part) > len(table_):
                    table_ = np.concatenate([table_, np.zeros_like(table_)])
                table_[len(known) : len(known) + len(part)] = model.scores(part)
                known.update(zip(part, range(len(known), len(known) + len(part))))
            return list(map(known.__getitem__, words))

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                if len(known) > CACHE_WORDS:
                    known.clear()
                split = [words_of(t or "") for t in part.column(2).to_pylist()]
                flat = np.array(numbers([w for words in split for w in words]), np.int32)
                coded = np.split(flat, np.cumsum([len(words) for words in split])[:-1])
                labels, scores = [UNKNOWN] * len(coded), [0.0] * len(coded)
                if model.labels:
                    for i, share in _shares(coded, table_, model.move):
                        best = int(share.argmax())
                        labels[i], scores[i] = model.labels[best], min(float(share[best]), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(labels), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return work


def _shares(coded: list[np.ndarray], table_: np.ndarray, move: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Mean marginals of each text with words, computed for texts of similar length
    together."""
    order = sorted((i for i in range(len(coded)) if len(coded[i])), key=lambda i: len(coded[i]))
    while order:
        longest, take = len(coded[order[-1]]), 1
        while take < len(order) and (take + 1) * longest <= GROUP_CELLS:
            take += 1
        group, order = order[-take:], order[:-take]
        mask = np.zeros((take, longest), bool)
        emit = np.zeros((take, longest, table_.shape[1]))
        for row, i in enumerate(group):
            mask[row, : len(coded[i])] = True
            emit[row, : len(coded[i])] = table_[coded[i]]
        marginal, _ = forward_backward(emit, move, mask, count=False)
        means = (marginal * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)
        yield from zip(group, means)


def identify(docs: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Rows whose crc32(doc_id as text) mod 4 is 2, or without doc_id, are held out; the
    model learns from a sample of the others. Null text or no letter: "und", score
    0; so is everything if no row has a label. Repeated rows are predicted alike. An
    empty table gives no rows. Extra columns are ignored.
    """
    ids = F.col("doc_id").cast("string")
    held = F.coalesce(F.crc32(ids) % 4 == 2, F.lit(True))
    model = train(sample_rows(docs.where(~held).select("doc_id", "text", "lang"), per_label))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(_labelled(model), "doc_id long, held_out boolean, lang_pred string, score double")


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))
