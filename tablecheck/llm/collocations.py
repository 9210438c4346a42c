"""Phrase collocations by multikey three-way quicksort of suffix pointers.

1. Words are counted per language. The most frequent ones, at most DICTIONARY, get small
   numbers that all tasks know; if those are not all frequent words, the others are named
   by a hash, and the counts show whether two words share one.
2. Every place of a text where two numbered words follow each other in a piece is a
   suffix of up to five words. A task combines its equal suffixes and routes them by their
   two leading words. A route that holds too many different suffixes is routed on by one
   leading word more, and its leading phrases are counted by sums; suffixes that stay
   equal to the last word are one row per task, so no repeated passage fills a route.
3. In each route the pointers are partitioned three ways by the word at a depth: the size
   of the equal part is the phrase's count, and it goes one word deeper. Parts under the
   least count are abandoned.
4. Counts of a phrase's parts come by joins with the counts themselves; all arithmetic is
   in whole numbers.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .base import cut, query, table

LONGEST = 5
LEAST = 100
DICTIONARY = 1 << 18  # words
ROUTE = 500_000  # suffixes aimed at; four times as many are routed on
HELD = 1_000_000  # distinct words, or suffixes, of a task before it hands them on
TEXT = 8_000_000  # bytes split at once
# Ends of pieces become a byte that no UTF-8 text holds, tabs become spaces.
MARK = b"\xff"
CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", MARK * 10 + b" ")
ROUTED = "route long, rows long, suffixes binary"


def lang(column: Column) -> Column:
    return F.coalesce(column, F.lit("und"))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(lang(F.col("lang")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def words_by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The words of many texts in order, MARK between pieces and texts."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // TEXT
        ends = [*(np.flatnonzero(np.diff(sizes)) + 1), batch.num_rows]
        for start, end in zip([0, *ends], ends):
            part, texts = batch.slice(start, end - start), defaultdict(list)
            for name, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                texts[name].append(text)
            for name, found in texts.items():
                # bytes.lower() changes A to Z only.
                yield name, MARK.join(found).lower().translate(CUTS).replace(MARK, b" \xff ").split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, defaultdict] = {}
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, known in held.items():
            words = [w for w in known if w != MARK]
            n = counts[name][[known[w] for w in words]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                names=["lang", "word", "n"],
            )
        held.clear()
        counts.clear()

    for name, words in words_by_lang(batches):
        if name not in held:
            held[name] = defaultdict()
            held[name].default_factory = held[name].__len__
            counts[name] = np.zeros(0, np.int64)
        known = held[name]
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        found = np.bincount(ids, minlength=len(known))
        found[: len(counts[name])] += counts[name]
        counts[name] = found
        if sum(map(len, held.values())) > HELD:
            yield from flush()
    yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words."""
    counted = texts_of(docs).mapInArrow(_counted, "lang string, word string, n long")
    return cut(counted.groupBy("lang", "word").agg(F.sum("n").alias("f")))


def word_hash(name: str, word: bytes, seed: int) -> int:
    """The same number as `hashed`, for a word outside the dictionary: below zero."""
    import xxhash

    first = xxhash.xxh64_intdigest(f"{seed}:{name}".encode(), 42)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(word, first) | 1 << 63))[0]


def hashed(seed: int) -> Column:
    made = F.xxhash64(F.concat(F.lit(f"{seed}:"), F.col("lang")), F.col("word"))
    return made.bitwiseOR(F.lit(-(2**63)).cast("long"))


class Dictionary:
    """Numbers of words: from 1 on for the dictionary, below 0 for others unless
    `whole` (then all others are infrequent), 0 for what no frequent phrase holds."""

    def __init__(self, numbers: dict[tuple[str, bytes], int], whole: bool, seed: int) -> None:
        self.whole, self.seed = whole, seed
        self.by_lang: dict[str, dict[bytes, int]] = defaultdict(dict)
        for (name, word), i in numbers.items():
            self.by_lang[name][word] = i

    def encoded(self, name: str, words: list[bytes]) -> np.ndarray:
        known = self.by_lang.get(name, {})
        if self.whole:
            return np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
        out = np.empty(len(words), np.int64)
        seen = {MARK: 0}
        for i, w in enumerate(words):
            if (n := known.get(w)) is None and (n := seen.get(w)) is None:
                n = seen[w] = word_hash(name, w, self.seed)
            out[i] = n
        return out


def suffixes_of(ids: np.ndarray) -> np.ndarray:
    """One row of LONGEST numbers per place where two words follow each other; 0 from
    the first end of a piece on."""
    padded = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
    at = np.flatnonzero((padded[:-LONGEST] != 0) & (padded[1 : len(ids) + 1] != 0))
    rows = padded[at[:, None] + np.arange(LONGEST)]
    rows[np.logical_or.accumulate(rows == 0, axis=1)] = 0
    return rows


def combined(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
    return rows[first], np.add.reduceat(counts, first)


def route_of(rows: np.ndarray, words: int, routes: int) -> np.ndarray:
    """The route of each row by its first `words` words."""
    mixed = np.zeros(len(rows), np.uint64)
    for j in range(words):
        mixed = (mixed ^ rows[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(routes)).astype(np.int64)


def packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Combined rows, each without the words it shares with the row before it."""
    length = (rows != 0).sum(1)
    shared = np.zeros(len(rows), np.int64)
    shared[1:] = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1).sum(1)
    at = np.arange(LONGEST)
    words = rows[(at >= shared[:, None]) & (at < length[:, None])]
    many = counts[counts != 1].astype("<i8")
    flags = (shared | length << 3 | (counts != 1) << 6).astype(np.uint8)
    small = words.min() >= 0 and words.max() < 1 << 24
    # Low and high bytes apart, as the high ones of frequent words are alike.
    planes = [(words & 0xFFFF).astype("<u2"), (words >> 16).astype(np.uint8)] if small else [words.astype("<i8")]
    raw = b"".join(x.tobytes() for x in (flags, many, *planes))
    head = struct.pack("<?qqqq", small, len(flags), len(many), len(words), len(raw))
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    """Rows of LONGEST words and a count."""
    head = struct.calcsize("<?qqqq")
    small, n, n_many, n_words, size = struct.unpack("<?qqqq", blob[:head])
    raw = pa.decompress(blob[head:], size, codec="zstd", asbytes=True)
    flags = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    shared, length = flags & 7, flags >> 3 & 7
    out = np.zeros((n, LONGEST + 1), np.int64)
    out[:, LONGEST] = 1
    out[flags >> 6 == 1, LONGEST] = np.frombuffer(raw, "<i8", n_many, n)
    start = n + 8 * n_many
    if small:
        words = np.frombuffer(raw, "<u2", n_words, start).astype(np.int64)
        words |= np.frombuffer(raw, np.uint8, n_words, start + 2 * n_words).astype(np.int64) << 16
    else:
        words = np.frombuffer(raw, "<i8", n_words, start)
    at = np.arange(LONGEST)
    own = (at >= shared[:, None]) & (at < length[:, None])
    out[:, :LONGEST][own] = words
    rows = np.arange(n)
    for j in range(LONGEST):
        source = np.maximum.accumulate(np.where(j >= shared, rows, 0))
        out[:, j] = out[source, j]
    return out


def routed(rows: np.ndarray, counts: np.ndarray, words: int, routes: int) -> Iterator[pa.RecordBatch]:
    """Combined rows by route, in batches of about 32 MB."""
    rows, counts = combined(rows, counts)
    to = route_of(rows, words, routes)
    order = np.argsort(to, kind="stable")
    to, rows, counts = to[order], rows[order], counts[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    parts = list(zip(cuts, [*cuts[1:], len(to)]))
    for start in range(0, len(parts), 256):
        some = parts[start : start + 256]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(to[a]) for a, _ in some], pa.int64()),
                pa.array([b - a for a, b in some], pa.int64()),
                pa.array([packed(rows[a:b], counts[a:b]) for a, b in some], pa.binary()),
            ],
            names=["route", "rows", "suffixes"],
        )


def _suffixes(dictionary, routes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for name, words in words_by_lang(batches):
            held.append(suffixes_of(dictionary.value.encoded(name, words)))
            if sum(map(len, held)) > HELD:
                rows = np.concatenate(held)
                held = []
                yield from routed(rows, np.ones(len(rows), np.int64), 2, routes)
        if held:
            rows = np.concatenate(held)
            yield from routed(rows, np.ones(len(rows), np.int64), 2, routes)

    return work


def _rerouted(words: int, routes: int):
    """Suffixes of at least `words` words, routed by so many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                rows = unpacked(raw)
                rows = rows[rows[:, words - 1] != 0]
                yield from routed(rows[:, :-1], rows[:, -1], words, routes)

    return work


def _prefixes(words: int):
    """Counts of the first `words` words, one row per phrase and packet."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                rows = unpacked(raw)
                rows = rows[rows[:, words - 1] != 0]
                yield phrase_rows(*combined(rows[:, :words], rows[:, -1]))

    return work


def phrase_rows(ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(ids).ravel(), pa.int64())
    offsets = pa.array(np.arange(len(ids) + 1) * ids.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, flat), pa.array(counts, pa.int64())], names=["ids", "a"])


def three_way(rows: np.ndarray, counts: np.ndarray, least: int, known: int) -> dict[int, list[tuple]]:
    """Phrases of at least `known` words that occur `least` times or more, by length:
    multikey quicksort of pointers to `rows`, abandoning rare parts."""
    columns = [np.ascontiguousarray(rows[:, j]) for j in range(LONGEST)]
    found: dict[int, list[tuple]] = defaultdict(list)
    waiting = [(np.arange(len(rows)), 0)]
    while waiting:
        pointers, depth = waiting.pop()
        if counts[pointers].sum() < least:
            continue
        words = columns[depth][pointers]
        pivot = np.sort(words[:: max(1, len(words) // 9)])
        pivot = pivot[len(pivot) // 2]
        waiting.append((pointers[words < pivot], depth))
        waiting.append((pointers[words > pivot], depth))
        if pivot == 0:
            continue
        equal = pointers[words == pivot]
        n = int(counts[equal].sum())
        if n >= least:
            if depth + 1 >= known:
                found[depth + 1].append((rows[equal[0], : depth + 1], n))
            if depth + 1 < LONGEST:
                waiting.append((equal, depth + 1))
    return found


def _sorted(least: int, known: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([unpacked(raw) for batch in batches for raw in batch.column(2).to_pylist()])
        for found in three_way(rows[:, :-1], rows[:, -1], least, known).values():
            yield phrase_rows(np.array([p for p, _ in found]), np.array([n for _, n in found]))

    return work


def numbered(counts: DataFrame, least: int, size: int, seed: int) -> tuple[DataFrame, Dictionary]:
    """The frequent words (lang, word, f, id) and the dictionary of the first `size`."""
    frequent = cut(counts.where(F.col("f") >= least))
    first = frequent.orderBy(F.desc("f"), "lang", "word").limit(size).select("lang", "word").toArrow()
    names, words = first["lang"].to_pylist(), first["word"].cast(pa.binary()).to_pylist()
    numbers = {pair: i + 1 for i, pair in enumerate(zip(names, words))}
    whole = len(numbers) < size or frequent.count() == size
    if not whole and counts.groupBy(hashed(seed).alias("id")).count().where("count > 1").limit(1).count():
        raise ValueError("two words share a hash: choose another seed")
    columns = {"lang": first["lang"], "word": first["word"], "number": pa.array(range(1, len(numbers) + 1), pa.int64())}
    rows = counts.sparkSession.createDataFrame(pa.table(columns))
    with_id = frequent.join(rows, ["lang", "word"], "left").withColumn("id", F.coalesce("number", hashed(seed)))
    return cut(with_id.drop("number")), Dictionary(numbers, whole, seed)


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, dictionary: int = DICTIONARY, route: int = ROUTE, seed: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 2 to 5 words that occur `least` times or more (ids, a), the frequent
    words (lang, word, f, id) and the number of words of each language (lang, n)."""
    spark = docs.sparkSession
    counts = word_counts(docs)
    totals = cut(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    words, numbers = numbered(counts, least, dictionary, seed)
    places = (words if numbers.whole else counts).agg(F.sum("f").alias("n")).first().n or 0
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), places // route + 1)
    shared = spark.sparkContext.broadcast(numbers)
    parts = cut(texts_of(docs).mapInArrow(_suffixes(shared, routes), ROUTED), "uncompressed")
    found, known = [], 2
    while True:
        full = parts.groupBy("route").agg(F.sum("rows").alias("n")).where(F.col("n") > 4 * route).select("route")
        full = cut(full)
        some = not full.isEmpty()
        fit = parts.join(full, "route", "left_anti") if some else parts
        found.append(fit.groupBy("route").applyInArrow(_sorted(least, known), "ids array<long>, a long"))
        if not some:
            break
        # These routes hold one phrase of `known` words in most of their rows, or few.
        parts = parts.join(full, "route", "left_semi").select("route", "rows", "suffixes")
        leading = parts.mapInArrow(_prefixes(known), "ids array<long>, a long")
        found.append(leading.groupBy("ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least))
        if known == LONGEST:
            break
        known += 1
        parts = cut(parts.mapInArrow(_rerouted(known, routes), ROUTED), "uncompressed")
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return cut(phrases), words, totals


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = 2000,
    share: int = 100,
    dictionary: int = DICTIONARY,
    route: int = ROUTE,
    seed: int = 0,
) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    `docs`: text and lang (null: "und"; null text: empty). A phrase is dropped if a longer
    one that holds it occurs at least `share` percent as often. Repeated rows count as
    often as they occur; ties in score and count go by the phrase's bytes; an empty table
    gives no row, and other columns are not read.
    """
    phrases, words, totals = frequent_phrases(docs, least, dictionary, route, seed)
    singles = words.select(F.array("id").alias("part"), F.col("f").alias("times"))
    parts = singles.unionByName(phrases.select(F.col("ids").alias("part"), F.col("a").alias("times")))
    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select(
        "*",
        F.slice("ids", F.lit(1), F.col("k")).alias("head"),
        F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("rest"),
        F.element_at("ids", 1).alias("id"),
    )
    of_lang = words.join(totals, "lang").select("id", "lang", "n")
    scored = (
        cuts.join(parts.select(F.col("part").alias("head"), F.col("times").alias("l")), "head")
        .join(parts.select(F.col("part").alias("rest"), F.col("times").alias("r")), "rest")
        .join(of_lang, "id")
    )
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole["a"] * whole["n"], whole["l"] * whole["r"])
    # The least score counts, then the least k.
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    best = scored.groupBy("ids", "a", "lang", "n").agg(least_cut)

    inside = [
        F.when((F.size("ids") > n) & (F.size("ids") >= i + n - 1), F.slice("ids", F.lit(i), F.lit(n)))
        for n in range(2, LONGEST)
        for i in range(1, LONGEST - n + 2)
    ]
    held = F.array_distinct(F.array_compact(F.array(*inside)))
    longer = phrases.select(F.explode(held).alias("ids"), F.col("a").alias("of")).groupBy("ids").agg(F.max("of").alias("of"))
    own = best.join(longer, "ids", "left").where(F.col("of").isNull() | (100 * F.col("of") < share * F.col("a")))
    own = own.select("ids", "lang", "a", "cut.l", "cut.r", "n", "cut.score")

    order = [F.desc("score"), F.desc("a")]
    first = own.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    named = first.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    phrase = F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase")
    named = named.groupBy("ids", "lang", "a", "l", "r", "n", "score").agg(phrase)
    final = Window.partitionBy("lang").orderBy(*order, "phrase")
    ranked = named.withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
spans AS (
  SELECT lang, k.k AS k, unnest(list_transform(
    range(1, len(w) - k.k + 2), lambda i: array_to_string(w[i:i + k.k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3), (4), (5)) k(k)),
f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM spans GROUP BY lang, k, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.w, c.f AS a, u.k AS k, l.f AS l, r.f AS r, t.n AS n,
    ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM f c, (VALUES (1), (2), (3), (4)) u(k), f l, f r, totals t
  WHERE u.k < c.k AND t.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:u.k], ' ') AND r.phrase = array_to_string(c.w[u.k + 1:], ' ')),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT DISTINCT s.lang, array_to_string(s.w[i.i:i.i + n.n - 1], ' ') AS phrase, s.f AS f
  FROM f s, (VALUES (2), (3), (4)) n(n), (VALUES (1), (2), (3), (4)) i(i)
  WHERE n.n < s.k AND i.i + n.n - 1 <= s.k),
longer AS (SELECT lang, phrase, max(f) AS f FROM held GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
  b.phrase, b.a, b.l, b.r, b.n::BIGINT AS n, b.score
FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
WHERE g.f IS NULL OR 100 * g.f < 100 * b.a
QUALIFY rank <= 2000
"""


@query("op13_collocations", SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
