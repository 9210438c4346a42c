"""Quality rules with a verdict per host.

Rules are boolean columns of a document. Their failures are counted per host
(domain, source); each rule's rate per host is shrunk towards the corpus with an
empirical beta prior, and a host with a shrunk rate above `max_rate` loses all its
documents, including those that pass the rules themselves.

    prior of a rule: m = mean rate; t = variance of the hosts' rates (weighted by
    documents) less what sampling alone gives, k = m(1-m)/t - 1 within [1, 10^6];
    shrunk rate of a host: (failures + m k) / (documents + k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .base import SPACE, WORD, cut, let, query, table, words_of

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
LIMITS = (1.0, 1e6)


def _covered(words: Column) -> Column:
    """Words in windows of eight that occur twice or more in the text.

    Hashes of the windows tell texts without any repeat; only for the others are
    the windows themselves sorted and compared."""

    def at(i: Column) -> Column:
        return F.slice(words, i + 1, WINDOW_WORDS)

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW_WORDS)

    def exact(rows: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            near = (F.get(rows, i - 1)["w"] == x["w"], F.get(rows, i + 1)["w"] == x["w"])
            return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

        found = F.sort_array(F.transform(F.filter(rows, same), lambda x: x["i"]))
        return let(found, span)

    def span(found: Column) -> Column:
        steps = F.transform(
            found, lambda p, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(found, k + 1) - p, F.lit(WINDOW_WORDS)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    windows = F.transform(starts, lambda i: F.struct(F.array_join(at(i), " ").alias("w"), i.alias("i")))
    hashes = F.transform(starts, lambda i: F.xxhash64(at(i)))
    none = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return (
        F.when(F.size(words) <= WINDOW_WORDS, F.lit(0)).when(none, F.lit(0)).otherwise(let(F.sort_array(windows), exact))
    )


def measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all
    long); zeros for a null or empty text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _covered(w).cast("long").alias("n_repeat_words"),
        ),
    )


def base_rules() -> dict[str, Column]:
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    }


def host_verdicts(scored: DataFrame, host: str, rules: list[str], max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host that is not null: host, n, and per rule r the failures
    `r_n` and the shrunk rate `r_rate`; host_failed if any rate is above the limit."""
    counts = cut(
        scored.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r)).alias(f"{r}_n") for r in rules])
    )
    # A single row for each prior; it is the only thing the driver sees.
    got = counts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("n").alias("n"),
        *[F.sum(f"{r}_n").alias(f"{r}_n") for r in rules],
        *[F.sum(F.col(f"{r}_n") * F.col(f"{r}_n") / F.col("n")).alias(f"{r}_q") for r in rules],
    ).first()
    out = counts
    for r in rules:
        strength, mean = _prior(got["hosts"], got["n"] or 0, got[f"{r}_n"] or 0, got[f"{r}_q"] or 0.0)
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_n") + mean * strength) / (F.col("n") + strength))
    worst = F.greatest(*[F.col(f"{r}_rate") for r in rules], F.lit(0.0))
    return out.withColumn("host_failed", worst > max_rate)


def _prior(hosts: int, n: int, failures: int, squares: float) -> tuple[float, float]:
    if not n:
        return LIMITS[0], 0.0
    mean = failures / n
    spread = squares / n - mean * mean - mean * (1 - mean) * hosts / n
    if spread <= 0:
        return LIMITS[1], mean
    return min(max(mean * (1 - mean) / spread - 1, LIMITS[0]), LIMITS[1]), mean


def apply_rules(
    docs: DataFrame, host: str = "source", keep: list[str] | None = None, max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """Columns `keep` of every document with the measures, base_failed,
    host_failed and kept.

    Texts are read once: measures go to the shared folder, from which the hosts
    are counted and the rows returned. Null or empty text: no words, so it fails.
    Null host: no verdict of a host. Repeated rows count as often as they occur.
    Columns of `keep` that share a name with an added one give way to it. An empty
    table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rules = base_rules()
    added = {*measured, *rules, "base_failed", "host_failed", "kept"}
    names = [c for c in keep if c not in added]
    with_measures = docs.select(
        *[F.col(f"`{c}`") for c in names], F.col(host).alias("__host"), measures(F.col("text")).alias("__m")
    ).select(*[F.col(f"`{c}`") for c in names], "__host", "__m.*")
    scored = cut(with_measures.withColumns(rules).withColumn("base_failed", rules["few_words"] | rules["repeats"]))
    hosts = host_verdicts(scored, "__host", list(rules), max_rate).select("host", "host_failed")
    joined = scored.join(hosts, F.col("__host") == F.col("host"), "left")
    failed = F.coalesce(F.col("host_failed"), F.lit(False))
    return joined.select(
        *[F.col(f"`{c}`") for c in names],
        *measured,
        "base_failed",
        failed.alias("host_failed"),
        (~F.col("base_failed") & ~failed).alias("kept"),
    )


def keep_good(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of `docs` that apply_rules keeps, with the same columns. Only host and
    failures are written for the hosts' counts; texts are measured a second time
    instead of being copied."""
    rules = base_rules()
    measured = docs.select(F.col(host).alias("__host"), measures(F.col("text")).alias("__m")).select("__host", "__m.*")
    scored = cut(measured.select("__host", *[v.alias(r) for r, v in rules.items()]))
    hosts = host_verdicts(scored, "__host", list(rules), max_rate).where("host_failed").select("host")
    rows = docs.select(F.struct("*").alias("__d"), F.col(host).alias("__host"), measures(F.col("text")).alias("__m"))
    good = rows.select("__d", "__host", "__m.*").where(~(rules["few_words"] | rules["repeats"]))
    return good.join(hosts, F.col("__host") == F.col("host"), "left_anti").select("__d.*")


def _prior_sql(rule: str) -> str:
    m, q = f"(sum({rule}) / sum(n))", f"(sum({rule} * {rule} / n) / sum(n))"
    spread = f"({q} - {m} * {m} - {m} * (1 - {m}) * count(*) / sum(n))"
    k = f"CASE WHEN {spread} <= 0 THEN 1e6 ELSE least(greatest({m} * (1 - {m}) / {spread} - 1, 1.0), 1e6) END"
    return f"(SELECT struct_pack(m := {m}, k := {k}) FROM hosts)"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w),
txt AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM win),
dup AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) AS c FROM txt) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
lin AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
dl AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lin
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dl USING (rid) LEFT JOIN cov USING (rid)),
r AS (SELECT *, n_words < 20 AS few, 100 * n_repeat_words > 30 * n_words AS rep FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count_if(few)::DOUBLE AS few, count_if(rep)::DOUBLE AS rep
  FROM r WHERE source IS NOT NULL GROUP BY source),
rate AS (SELECT h.source, greatest((few + a.m * a.k) / (n + a.k), (rep + b.m * b.k) / (n + b.k)) > 0.5 AS bad
  FROM hosts h, (SELECT {_prior_sql("few")} AS a, {_prior_sql("rep")} AS b))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR rep AS base_failed,
  coalesce(bad, false) AS host_failed, NOT (few OR rep) AND NOT coalesce(bad, false) AS kept
FROM r LEFT JOIN rate USING (source)
"""


@query("op2_quality_rules", SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return apply_rules(table(spark, folder, "documents"))
