"""Near-duplicates by bottom-k sketches of one hash function.

1. Texts with equal shingle sets form a class; its sketch is the k least hashes.
2. Inverted lists: documents that share a retained value. A pair above the threshold
   shares at least OVERLAP of a sketch, so it meets on one of the values that remain
   when the OVERLAP most frequent ones of each sketch are left out. Lists are made
   of those only: passages in very many documents make no list unless they are most
   of a document.
3. Short lists give all their pairs. Long lists give stars: every member with a few
   centres (the smallest set, the most central sketch, a random one). Members that
   no star has put into the main component of their family are then compared block
   by block with all its members, on full sets and inside tasks: only links leave.
4. The union sketch (k least of both) estimates the similarity and filters pairs; the
   full sets confirm. Components of confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .base import cut, query, table
from .components import components
from .shingles import shared, shingle_set

K = 64
OVERLAP = 9 / 16  # of a sketch: 4.7 standard deviations below what 0.8 shares of 64
SHORT_LIST = 32
LEFT_BLOCK, RIGHT_BLOCK = 256, 512
SIGMAS = 6


def _sketches(words: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_set(t or "", words) for t in part.column(1).to_pylist()]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                least = [s[:k].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(least, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "key", "sketch"],
                )

    return work


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[float, int]:
    """Similarity of two sets from the k least values of their union, and how many
    values that is."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean()), len(union)


def _passes(a: np.ndarray, b: np.ndarray, k: int, percent: int) -> bool:
    share, n = estimate(a, b, k)
    t = percent / 100
    return share >= t - SIGMAS * math.sqrt(t * (1 - t) / n)


def _estimated(k: int, percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [
                _passes(np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64), k, percent)
                for x, y in zip(left, right)
            ]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return work


def _confirmed(words: int, percent: int):
    """Pairs whose full sets reach the threshold. Rows come ordered by `a`, whose set
    is made once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            ids, ok = batch.column(0).to_pylist(), []
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for a, x, y in zip(ids[start:], part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if a != last:
                        last, held = a, shingle_set(x, words)
                    other = shingle_set(y, words)
                    n = shared(held, other)
                    ok.append(100 * n >= percent * (len(held) + len(other) - n))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return work


def _compared(words: int, percent: int):
    """Links between two blocks of one family, from full sets: for every document on
    the left one for each component on the right that it is linked to."""

    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets = [shingle_set(t, words) for t in right["text"]]
            sizes = np.array([len(s) for s in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            comps, ids = right["comp"].to_numpy(), right["cid"].to_numpy()
            for cid, comp, text in zip(left["cid"], left["comp"], left["text"]):
                mine = shingle_set(text, words)
                at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                both = np.bincount(owner[mine[at] == values], minlength=len(sets))
                linked = 100 * both >= percent * (sizes + len(mine) - both)
                one = {c: i for c, i in zip(comps[linked], ids[linked]) if c != comp}
                found += [(min(cid, i), max(cid, i)) for i in one.values()]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return work


def _near(percent: int) -> Column:
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def classes(docs: DataFrame, words: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key) of all rows, and (cid, n, key, sketch) of the classes: rows
    with equal, non-empty shingle sets, named by their least doc_id."""
    rows = cut(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            _sketches(words, k), "doc_id long, n long, key binary, sketch array<long>"
        )
    )
    found = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key")
    found = found.agg(F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return rows.select("doc_id", "n", "key"), cut(found)


def inverted_lists(found: DataFrame, k: int = K) -> DataFrame:
    """v, cid, n, score: the values of each sketch that make lists, with the sum of
    the sketch's document frequencies."""
    values = found.select("cid", "n", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = values.join(often, "v")
    size = F.least("n", F.lit(k))
    need = F.greatest(F.ceil(size * OVERLAP), F.lit(1))
    rare = size - F.count(F.lit(1))  # values that no other document retains come first
    per_class = met.groupBy("cid", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"),
        (size - need + 1 - rare).cast("int").alias("left"),
        F.sum("df").alias("score"),
    )
    used = per_class.where("left > 0").withColumn("vs", F.slice("vs", F.lit(1), F.col("left")))
    return used.select("cid", "n", "score", F.explode("vs.v").alias("v"))


def _pairs(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a, b); members of long lists; their edges to a centre."""
    member = F.struct(F.col("n").alias("m"), F.col("cid").alias("center"))
    heads = lists.groupBy("v").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(member).alias("small"),
        F.max(F.struct("score", member.alias("c")))["c"].alias("central"),
        F.min(F.struct(F.xxhash64("v", "cid").alias("h"), member.alias("c")))["c"].alias("any"),
    )
    rows = cut(lists.join(heads.where("size > 1"), "v"))
    short = rows.where(F.col("size") <= SHORT_LIST).select("v", "cid", "n")
    other = short.select("v", F.col("cid").alias("center"), F.col("n").alias("m"))
    all_pairs = short.join(other, "v").where("cid < center").where(_near(percent)).select("cid", "center")
    long = rows.where(F.col("size") > SHORT_LIST)
    spokes = long.select("cid", "n", F.explode(F.array("small", "central", "any")).alias("c")).select("cid", "n", "c.*")
    stars = spokes.where("cid <> center").where(_near(percent)).select("cid", "center")
    pairs = all_pairs.unionByName(stars).select(F.least("cid", "center").alias("a"), F.greatest("cid", "center").alias("b"))
    family = long.select(F.col("cid").alias("a"), F.col("small.center").alias("b")).distinct()
    return pairs.distinct(), rows.select("cid").distinct(), family


def links(found: DataFrame, docs: DataFrame, words: int, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes that connect every group."""
    pairs, members, family = _pairs(inverted_lists(found, k), percent)
    texts = cut(
        docs.select(F.col("doc_id").cast("long").alias("cid"), F.coalesce("text", F.lit("")).alias("text"))
        .join(members, "cid")
        .dropDuplicates(["cid"])
    )
    sketch = found.select("cid", "sketch")

    def side(df: DataFrame, name: str, value: str) -> DataFrame:
        return df.select(F.col("cid").alias(name), F.col(value).alias(f"{value}_{name}"))

    def confirmed(candidates: DataFrame) -> DataFrame:
        joined = candidates.join(side(texts, "b", "text"), "b").join(side(texts, "a", "text"), "a")
        joined = joined.select("a", "b", "text_a", "text_b")
        return joined.mapInArrow(_confirmed(words, percent), "a long, b long")

    sketched = pairs.join(side(sketch, "b", "sketch"), "b").join(side(sketch, "a", "sketch"), "a")
    passed = sketched.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimated(k, percent), "a long, b long")
    first = cut(confirmed(passed))
    family = cut(family)
    if family.isEmpty():
        return first
    return first.unionByName(_rest(texts, first, family, words, percent))


def _rest(texts: DataFrame, first: DataFrame, family: DataFrame, words: int, percent: int) -> DataFrame:
    """Links within families of long lists between different components so far:
    members outside a family's main component against all its members."""
    families = components(family).select(F.col("node").alias("cid"), F.col("root").alias("fam"))
    comps = components(first).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    members = families.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    counts = members.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("fam").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.sum("c").alias("m"))
    members = members.join(main, "fam")
    apart = F.col("comp") != F.col("main")
    outside = members.where(apart).groupBy("fam").agg(F.count(F.lit(1)).alias("u"))
    rows = cut(members.join(outside, "fam").join(texts, "cid"))
    lefts, rights = F.ceil(F.col("u") / LEFT_BLOCK), F.ceil(F.col("m") / RIGHT_BLOCK)
    columns = ["fam", "lb", "rb", "cid", "comp", "text"]
    left = rows.where(apart).withColumn("lb", F.pmod(F.xxhash64("cid"), lefts))
    left = left.withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), rights - 1))).select(columns)
    right = rows.withColumn("rb", F.pmod(F.xxhash64("cid", F.lit(1)), rights))
    right = right.withColumn("lb", F.explode(F.sequence(F.lit(0).cast("long"), lefts - 1))).select(columns)
    keys = ["fam", "lb", "rb"]
    others = right.toDF(*columns).groupBy(*keys)  # fresh names: both sides read one table
    return cut(left.groupBy(*keys).cogroup(others).applyInPandas(_compared(words, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of
    both. A document with fewer than `words` words is one shingle. Without words or
    with a null text: no shingle, a component of its own. Null doc_id: linked with
    nothing, component_id null, not kept. Repeated rows share their component. An
    empty table gives no rows. Extra columns are ignored.
    """
    rows, found = classes(docs, words, k)
    roots = components(links(found, docs, words, k, percent))
    named = found.select("key", "cid").join(roots, F.col("cid") == F.col("node"), "left")
    named = named.select("key", F.coalesce("root", "cid").alias("root"))
    joined = rows.join(named, "key", "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """The rows of `docs` less all but one document of each group; of rows with one
    doc_id one stays, and rows without doc_id all stay."""
    verdict = near_duplicates(docs, words, percent, k).where("kept").select("doc_id")
    ids = cut(verdict.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")))
    joined = docs.join(ids, "doc_id").select(*[docs[c] for c in docs.columns], "__rows")
    single = joined.where("__rows = 1").drop("__rows")
    several = joined.where("__rows > 1").drop("__rows").dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(docs.where("doc_id IS NULL"))


@query("op10_minhash_neardup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
