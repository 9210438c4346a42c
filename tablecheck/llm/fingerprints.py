"""I-Match fingerprints with randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band: neither so
rare that one edit creates or destroys them nor so common that they tell nothing. A
fingerprint consists of one hash per lexicon subset: the document's distinct terms
in that subset, sorted, hashed. Subsets have several densities, so that short and
long documents each have some that keep a few of their terms; subsets of one density
are disjoint, and those of the first hold the whole band. The likeness of two fingerprints is the share of equal hashes among
the subsets that either document touches.

The lexicon is at most (distinct terms per document) / LOW, whatever the number of documents, and is sent to all tasks only after
its size is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .base import cut, query, table

TERM = r"[\p{L}\p{N}]+"
LOW, HIGH, LEAST_DOCUMENTS = 0.0005, 0.1, 2
DENSITIES = (8, 32, 128, 512, 2048)  # a subset of a density holds one term in so many
SUBSETS = 8  # of each density; as many as the first, so that no term is left out
BROADCAST_TERMS = 1_000_000
BUCKET_ROWS, KNOTS = 4000, 64


def terms_of(text: Column) -> Column:
    """Distinct lower-case terms."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def subsets_of(term: Column) -> Column:
    """Numbers of the subsets that hold a term."""
    found = []
    for i, density in enumerate(DENSITIES):
        place = F.pmod(F.xxhash64(term, F.lit(i)), F.lit(density)).cast("int")
        found.append(F.when(place < SUBSETS, place + i * SUBSETS))
    return F.array_compact(F.array(*found))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term, subsets for the terms in the band."""
    n = docs.count()
    # explode_outer, because Spark would evaluate the terms of explode again in a filter.
    terms = docs.select(F.explode_outer(terms_of(F.coalesce("text", F.lit("")))).alias("term"))
    terms = terms.where(F.col("term").isNotNull())
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counts.where((F.col("n") >= max(LEAST_DOCUMENTS, low * n)) & (F.col("n") <= high * n))
    return cut(band.select("term", subsets_of(F.col("term")).alias("subsets")))


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, guest, bucket, place: documents by descending doc_id
    (null last; equal ids by a hash of the text), each with the text that follows,
    the first one after the last.

    Ranges of doc_id, cut at quantiles and evenly between them, are the buckets;
    each sees, as a guest at its end, the first document of the next bucket.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    ends = [i / KNOTS for i in range(KNOTS + 1)]
    ids = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", ends, 10_000).alias("k")).first()
    knots = sorted(set(ids["k"] or [0]))
    fine = max(1, -(-ids["n"] // (BUCKET_ROWS * KNOTS)))
    at = F.lit(-1).cast("long")
    for i in range(len(knots) - 1, -1, -1):
        lo, hi = knots[i], knots[min(i + 1, len(knots) - 1)]
        part = F.least(F.floor((F.col("doc_id") - lo) / F.lit(float(max(hi - lo, 1))) * fine), F.lit(fine - 1))
        inside = i * fine + F.greatest(part, F.lit(0)).cast("long")
        at = inside if i == len(knots) - 1 else F.when(F.col("doc_id") < knots[i + 1], inside).otherwise(at)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(at)
    rows = rows.withColumn("bucket", bucket)
    key = F.struct(F.bitwise_not("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    heads = rows.groupBy("bucket").agg(F.min(key).alias("head"))
    by = Window.orderBy(F.col("bucket").desc())  # one row per bucket
    before = F.coalesce(F.lag("bucket").over(by), F.min("bucket").over(Window.partitionBy()))
    heads = cut(heads.select(before.alias("host"), F.col("bucket").alias("__b"), "head"))
    same = (
        (F.col("bucket") == F.col("__b"))
        & F.bitwise_not("doc_id").eqNullSafe(F.col("head.d"))
        & (F.xxhash64("text") == F.col("head.h"))
    )
    guests = rows.join(heads, same).select("doc_id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests).select(
        "*", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("place")
    )


def likeness(a: Column, b: Column) -> Column:
    """Arrays of (subset, hash): equal hashes / subsets in either."""
    either = F.size(F.array_union(F.transform(a, lambda x: x["s"]), F.transform(b, lambda x: x["s"])))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0).cast("double")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next for every document.

    A document without a lexicon term has, under subset -1, the hash
    of all its terms. Null text: empty. Equal texts have equal fingerprints; repeated
    rows are documents of their own. An empty table gives no rows. Extra columns are
    ignored. Terms stay in the task that holds their document, so after the texts'
    one exchange only the lexicon's counts are shuffled.
    """
    words = lexicon(docs, low, high)
    few = words.count() <= BROADCAST_TERMS
    rows = _ordered(docs)
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - k), F.col("next_text").substr(F.lit(1), k))
    texts = rows.select(
        "bucket", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")
    )
    texts = texts.withColumn("sha", F.sha2(F.coalesce("edited", F.lit("")), 256))
    info = F.struct("guest", "doc_id", "n_chars", "sha")
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("kind"), F.coalesce("edited", F.lit("")).alias("t")),
    )
    kinds = texts.select("bucket", "place", info.alias("info"), F.explode(both).alias("k"))
    found = kinds.select("bucket", "place", "info", "k.kind", terms_of(F.col("k.t")).alias("terms"))
    # The first element stands for the document: it carries what else is known of it.
    listed = found.select(
        "bucket",
        "place",
        "kind",
        "info",
        F.xxhash64(F.sort_array("terms")).alias("all"),
        F.explode_outer(F.concat(F.array(F.lit("")), F.col("terms"))).alias("term"),
    )
    first = F.col("term") == ""
    listed = listed.select(
        "bucket", "place", "kind", "term", F.when(first, F.struct("info", "all")).alias("head")
    )
    mark = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.array(F.lit(-1)).alias("subsets"))
    words = words.unionByName(mark)
    hits = listed.join(F.broadcast(words) if few else words, "term")
    hits = hits.select("bucket", "place", "kind", F.explode("subsets").alias("s"), "term", "head")
    hashed = hits.groupBy("bucket", "place", "kind", "s").agg(
        F.xxhash64(F.sort_array(F.collect_list("term"))).alias("h"), F.max("head").alias("head")
    )
    value = F.struct("s", F.when(F.col("s") < 0, F.col("head.all")).otherwise(F.col("h")).alias("h"))

    def of(kind: int) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, value)))

    def own(found: Column) -> Column:
        real = F.filter(found, lambda x: x["s"] >= 0)
        return F.when(F.size(real) > 0, real).otherwise(found)

    marks = hashed.groupBy("bucket", "place").agg(
        of(0).alias("a"), of(1).alias("b"), F.max(F.col("head.info")).alias("info")
    )
    marks = marks.select("bucket", "place", "info", own(F.col("a")).alias("a"), own(F.col("b")).alias("b"))
    order = Window.partitionBy("bucket").orderBy("place")

    def text_of(values: Column) -> Column:
        one = F.transform(values, lambda x: F.concat(F.lpad(F.hex(x["s"] + 1), 2, "0"), F.lpad(F.hex(x["h"]), 16, "0")))
        return F.lower(F.array_join(one, ""))

    return (
        marks.withColumn("next", F.lead("a").over(order))
        .where(~F.col("info.guest"))
        .select(
            "info.doc_id",
            "info.n_chars",
            F.col("info.sha").alias("edited_sha256"),
            text_of(F.col("a")).alias("fingerprint"),
            text_of(F.col("b")).alias("edited_fingerprint"),
            likeness(F.col("a"), F.col("b")).alias("near_edited"),
            likeness(F.col("a"), F.col("next")).alias("near_next"),
        )
    )


@query("op5_fingerprints")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))
