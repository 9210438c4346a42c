"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. The whole part of target / size is allocated to
every document as certain copies. One more copy goes to a sample without replacement
of fixed size (in words) with unequal probabilities: a document's inclusion is in
proportion to its words, and where that would reach 1 the copy is certain too. The
others are ranked by random odds divided by the odds of their inclusion and taken in
that order until the rest is reached, to within half a document. Random numbers come
from a hash of the seed and doc_id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .base import SPACE, cut, query, table

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_COPIES = 2
CHUNKS = 4096
SEED = "mix"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return (F.size(parts) - F.size(F.filter(parts, lambda p: p == ""))).cast("long")


def targets(sizes: DataFrame, share_percent: int = SHARE_PERCENT, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size -> with weight and target.

    Sources ordered by code point, null last, weigh WEIGHTS in turn and share
    share_percent of all sizes; none gets more than max_copies times its size, and
    the excess goes to the others by weight. With the sources ordered by cap per
    weight, the common level is the largest of (total - caps before) / (weights not
    before). One row per source in a single task, nothing else.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    caps = sizes.withColumn("weight", weight).withColumn("cap", max_copies * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()

    def past(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    total = F.sum("source_size").over(all_rows) * share_percent / 100
    left = F.sum("weight").over(all_rows) - past("weight")
    levels = caps.withColumn("level", (total - past("cap")) / left)
    level = F.max("level").over(all_rows)
    return levels.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target"),
    )


def inclusions(by_size: DataFrame, plan: DataFrame) -> DataFrame:
    """source, size, n (documents of that size) and plan (source, need) -> per source
    `rate`, inclusion per word, and `open`, words of the sample beyond certain copies.

    Inclusion is least(1, rate * size), and the words expected are `need`. The rate lies
    between 1 / size of two neighbouring sizes: with the sizes up to s in proportion and
    the larger ones certain, the expected words at rate 1 / s are squares / s + words of
    the larger, and s is the largest size at which they reach `need`. One row per size,
    not per document, goes through the windows.
    """
    size, n = F.col("size"), F.col("n")
    words = F.sum((n * size).cast("decimal(38,0)"))
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = by_size.where("size > 0").select(
        "source",
        "size",
        F.sum((n * size).cast("decimal(38,0)") * size).over(upto).cast("double").alias("squares"),
        (words.over(Window.partitionBy("source")) - words.over(upto)).cast("double").alias("larger"),
    )
    need = plan.select(F.col("source").alias("__s"), "need").where("need > 0")
    there = sums.join(need, F.col("source").eqNullSafe(F.col("__s")))
    enough = F.col("squares") + F.col("size") * F.col("larger") >= F.col("size") * F.col("need")
    at = F.max(F.struct("size", "squares", "larger")).alias("at")
    rates = there.where(enough).groupBy("source", "need").agg(at)
    rates = rates.select("source", "need", ((F.col("need") - F.col("at.larger")) / F.col("at.squares")).alias("rate"))
    sure = by_size.join(
        rates.select(F.col("source").alias("__s"), "rate", "need"), F.col("source").eqNullSafe(F.col("__s"))
    )
    certain = F.sum(F.when(F.col("rate") * size >= 1, (n * size).cast("decimal(38,0)")).otherwise(0))
    return sure.groupBy("source", "rate", "need").agg(certain.cast("double").alias("certain")).select(
        "source", "rate", (F.col("need") - F.col("certain")).alias("open")
    )


def sample_ends(ranked: DataFrame, chunks: int = CHUNKS) -> DataFrame:
    """source, __rank, doc_id, __tie, __row, size, open -> per source `__end`, the last
    row that its sample takes; a source whose sample is empty has none.

    Ranks are cut into `chunks` ranges, the range in which a sample ends into as many
    again, and rows are sorted only in the range of a range that is left: narrow rows,
    a 16-millionth of the ranks.
    """
    fine = F.least(F.floor(F.col("__rank") * chunks * chunks), F.lit(chunks * chunks - 1)).cast("long")
    rows = ranked.withColumn("__fine", fine).withColumn("__chunk", F.floor(F.col("__fine") / chunks))
    rows = rows.withColumn("__ahead", F.lit(0).cast("long"))
    for level in ("__chunk", "__fine"):
        sums = rows.groupBy("source", "open", "__ahead", level).agg(F.sum("size").alias("__sum"))
        before = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.col("__ahead") + F.coalesce(F.sum("__sum").over(before), F.lit(0))
        # The last range that begins within the sample: it ends there or with it.
        reached = sums.withColumn("__at", ahead).where(F.col("__at") < F.col("open"))
        edge = reached.groupBy("source").agg(F.max(F.struct(level, "__at")).alias("e"))
        edge = cut(edge.select(F.col("source").alias("__s"), F.col(f"e.{level}").alias("__l"), F.col("e.__at").alias("__a")))
        match = F.col("source").eqNullSafe(F.col("__s")) & (F.col(level) == F.col("__l"))
        rows = rows.drop("__ahead").join(edge, match).withColumnRenamed("__a", "__ahead").drop("__s", "__l")
    order = ["__rank", "doc_id", "__tie", "__row"]
    inside = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("__ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    first = F.col("__fine") / F.lit(float(chunks * chunks))
    sorted_rows = rows.withColumn("__in", ahead + F.col("size") / 2 <= F.col("open")).withColumn("__from", first)
    last = F.max(F.when(F.col("__in"), F.struct(*order)))
    return sorted_rows.groupBy("source").agg(last.alias("__end"), F.min("__from").alias("__from"))


def allocate(docs: DataFrame, keep: list[str] | None = None, seed: str = SEED, chunks: int = CHUNKS) -> DataFrame:
    """Columns `keep` of every document with size, source_size, target, copies
    (how often the mix takes it) and taken (size * copies).

    A document is decided by its own rank and one value per source, so texts are
    neither sorted nor shuffled, and a source of any size is spread over all tasks.
    Null text: size 0. Null source: a source of its own. Repeated rows are documents of
    their own; rows that agree in doc_id and text are interchangeable. An empty table
    gives no rows. Columns of `keep` that share a name with an added one give way to it.
    """
    keep = ["doc_id"] if keep is None else keep
    added = ["size", "source_size", "target", "copies", "taken"]
    names = [c for c in keep if c not in added and c not in ("source", "doc_id")]
    rest = [F.col(f"`{c}`") for c in names]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long")
    sized = cut(
        docs.select(
            "doc_id",
            "source",
            *rest,
            n_words(F.col("text")).alias("size"),
            ((bits + F.lit(0.5)) / F.lit(float(1 << 52))).alias("__u"),
            F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("__tie"),
            F.monotonically_increasing_id().alias("__row"),  # written, so it stays the same
        )
    )
    by_size = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sure = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = cut(targets(sums).select("source", "source_size", "target", sure.alias("__sure")))
    need = plan.select("source", (F.col("target") - F.col("__sure") * F.col("source_size")).alias("need"))
    rates = cut(inclusions(by_size, need))

    u, p = F.col("__u"), F.col("rate") * F.col("size")
    rank = u * (1 - p) / (u * (1 - p) + (1 - u) * p)  # r / (1 + r), r: the ratio of the odds
    of_rate = rates.select(F.col("source").alias("__rs"), "rate", "open")
    fraction = sized.where("size > 0").select("source", "doc_id", "size", "__u", "__tie", "__row")
    fraction = fraction.join(of_rate, F.col("source").eqNullSafe(F.col("__rs"))).where(p < 1)
    ends = sample_ends(fraction.withColumn("__rank", rank).drop("__u", "rate", "__rs"), chunks)

    decisions = (
        plan.join(of_rate, F.col("source").eqNullSafe(F.col("__rs")), "left")
        .join(ends.withColumnRenamed("source", "__es"), F.col("source").eqNullSafe(F.col("__es")), "left")
        .select(F.col("source").alias("__s"), "source_size", "target", "__sure", "rate", "__end", "__from")
    )
    here = F.struct(rank.alias("__rank"), "doc_id", "__tie", "__row")
    # Without a row in the last range, the sample ends where that range begins.
    sampled = F.when(F.col("__end").isNotNull(), here <= F.col("__end")).otherwise(rank < F.col("__from"))
    more = F.when(F.col("rate").isNull() | (F.col("size") == 0), False).when(p >= 1, True).otherwise(sampled)
    copies = (F.col("__sure") + F.coalesce(more, F.lit(False)).cast("int")).cast("long")
    out = sized.join(cut(decisions), F.col("source").eqNullSafe(F.col("__s"))).withColumn("copies", copies)
    lead = [c for c in ("doc_id", "source") if c in keep]
    return out.select(*lead, *rest, *added[:3], "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, keep: list[str], seed: str = SEED) -> DataFrame:
    """The rows of the mix: every document as often as it is taken."""
    taken = allocate(docs, keep, seed).where("copies > 0")
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(f"`{c}`") for c in keep])


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
  md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, ((sum(source_size) OVER ()) * 150 / 100::DOUBLE
    - coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE)
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level FROM s
  WINDOW before AS (ORDER BY 2 * source_size::DOUBLE / w, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * max(level) OVER ()) AS target FROM f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS sure FROM t),
p AS (SELECT *, target - sure * source_size AS need FROM n),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
y AS (SELECT source, size, sum(n * size * size) OVER up AS squares,
  sum(n * size) OVER (PARTITION BY source) - sum(n * size) OVER up AS larger FROM z
  WINDOW up AS (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT p.source, need, max({'size': size, 'squares': squares::DOUBLE, 'larger': larger::DOUBLE}) AS best
  FROM y JOIN p ON y.source IS NOT DISTINCT FROM p.source
  WHERE need > 0 AND squares::DOUBLE + size::DOUBLE * larger::DOUBLE >= size::DOUBLE * need GROUP BY p.source, need),
i AS (SELECT source, need, (need - best.larger) / best.squares AS rate FROM x),
w AS (SELECT i.source, rate, need - coalesce(sum(n * size) FILTER (rate * size::DOUBLE >= 1), 0)::DOUBLE AS open
  FROM i JOIN z ON z.source IS NOT DISTINCT FROM i.source GROUP BY i.source, rate, need),
r AS (SELECT d.*, source_size, target, sure, open,
  CASE WHEN rate IS NULL OR size = 0 THEN 0 ELSE rate * size::DOUBLE END AS i
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN w ON d.source IS NOT DISTINCT FROM w.source),
o AS (SELECT *, i > 0 AND i < 1 AS drawn, u * (1 - i) / (u * (1 - i) + (1 - u) * i) AS rank FROM r),
b AS (SELECT *, sum(size) OVER (PARTITION BY source, drawn ORDER BY rank, doc_id, tie
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead FROM o),
e AS (SELECT *, (sure + CASE WHEN i >= 1 OR (drawn AND ahead + size / 2 <= open) THEN 1 ELSE 0 END)::BIGINT AS copies FROM b)
SELECT doc_id, size, source_size, target, copies, (size * copies)::BIGINT AS taken FROM e
"""


@query("op4_mixing", SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return allocate(table(spark, folder, "documents"))
