"""Order-dependent checks: validity intervals and late arrivals.

A plain `Window.partitionBy(key)` would put all rows of a hot key into one task.
Hot keys (more than HOT_ROWS rows) are therefore cut into buckets along the full
order of their rows, at quantiles, so that neither an outlier nor a position that
most rows share fills one bucket. Each bucket is reduced to one summary row
(combined on the map side), the summaries of a key get a prefix maximum, and only
rows of one (key, bucket) meet in a task. All other keys have a single bucket and
no summary, so data without hot keys pays for one narrow count per key. Where the
cuts lie never changes the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.predicates import names_where
from ..functions.times import epoch_micros, from_epoch_micros, instant_micros
from ..verdict import Judgement, Measurement, result, zero
from .aggregates import count_if, rows


# A key with fewer rows is sorted within one task. At most HOT_KEYS keys, the
# largest, are cut; every other key then holds at most rows / HOT_KEYS rows. Their
# cuts, at most rows / bucket_rows, are broadcast: 24 MB in a trillion rows.
HOT_ROWS = 10_000_000
BUCKET_ROWS = 1_000_000
HOT_KEYS = 100_000
# Rows of a sample per bucket: sizes then vary by an eighth.
SAMPLED = 64
# A bucket of copies is cut further; its parts are numbered within it.
PARTS = 1 << 24
# Cuts are looked up in a tree of three levels: on the lower two a row carries at most
# FAN of them, on the top one in FAN * FAN of those of its key.
FAN = 64


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """The largest keys with more than `hot_rows` rows, as `_h_<key>`, and their rows `_n`."""
    names = [f"_h_{k}" for k in keys]
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(rows().alias("_n"))
    return counts.filter(F.col("_n") > hot_rows).orderBy(F.desc("_n"), *names).limit(HOT_KEYS)


def hot_cuts(
    df: DataFrame, keys: Sequence[str], position: str, tie: str, hot_rows: int, bucket_rows: int
) -> DataFrame:
    """Per hot key the ascending `_cuts` (p, t, parts): where its buckets begin.

    Rows equal in position and tie are counted, then sampled by a hash of their
    values with a chance in proportion to the count, so all branches of a plan see
    the same sample. A value with as many rows as a bucket begins one of its own and
    so does what follows it; `parts` is the number of buckets that it fills.
    """
    hot = F.broadcast(hot_keys(df, keys, hot_rows))
    names = [f"_h_{k}" for k in keys]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    values = df.join(hot, same).groupBy(*names, F.col(position).alias("p"), F.col(tie).alias("t"))
    step = max(1, bucket_rows // SAMPLED)
    n = F.col("n")
    drawn = F.pmod(F.xxhash64(*names, "p", "t"), F.lit(step)) < n
    sample = values.agg(rows().alias("n")).filter(drawn).withColumn("w", F.greatest(n, F.lit(step)))
    order = W.partitionBy(*names).orderBy("p", "t")
    before = F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1))
    own = n >= bucket_rows
    marked = sample.withColumn("_at", F.floor(F.coalesce(before, F.lit(0)) / bucket_rows)).withColumn("_own", own)
    first = F.col("_at") > F.coalesce(F.lag("_at").over(order), F.lit(0))
    after = F.coalesce(F.lag("_own").over(order), F.lit(False))
    parts = F.when(F.col("_own"), F.ceil(n / F.lit(bucket_rows))).otherwise(F.lit(1)).cast("int").alias("parts")
    cuts = marked.withColumn("_cut", first | F.col("_own") | after).select(*names, "_cut", F.struct("p", "t", parts).alias("c"))
    kept = F.array_sort(F.collect_list(F.when(F.col("_cut"), F.col("c"))))
    return cuts.groupBy(*names).agg(kept.alias("_cuts"))


def cut_nodes(cuts: DataFrame, names: Sequence[str], span: int) -> DataFrame:
    """Every `span`-th cut in arrays of FAN: key, `_node` (place among these arrays) and
    the ascending `_cuts`."""
    chosen = cuts.select(*names, F.posexplode("_cuts").alias("_i", "_c")).filter(F.col("_i") % span == 0)
    node = F.floor(F.col("_i") / (span * FAN)).alias("_node")
    return chosen.groupBy(*names, node).agg(F.array_sort(F.collect_list("_c")).alias("_cuts"))


def place_among(cuts: Column, value: Column, most: int) -> Column:
    """How many of the ascending `cuts`, under 2 * `most`, are at most `value`: by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in range(most.bit_length() - 1, -1, -1)])

    def step(at: Column, size: Column) -> Column:
        there = F.get(cuts, at + size - 1)
        reached = (at + size <= F.size(cuts)) & (F.struct(there["p"], there["t"]) <= value)
        return F.when(F.coalesce(reached, F.lit(False)), at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_bucket(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    tie: str,
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    split_copies: bool = False,
) -> DataFrame:
    """Adds `_bucket`, which never decreases along (`position`, `tie`), two numbers,
    within a key, and `_hot`. Rows equal in both stay together unless `split_copies`;
    then it must not matter to the caller which of them comes first."""
    names = [f"_h_{k}" for k in keys]
    cuts = hot_cuts(df, keys, position, tie, hot_rows, bucket_rows)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    value = F.struct(F.col(position), F.col(tie))
    top = cuts.withColumn("_cuts", F.filter("_cuts", lambda c, i: i % (FAN * FAN) == 0))
    joined = df.join(F.broadcast(top), same, "left").withColumn("_hot", F.col("_cuts").isNotNull())
    place = F.when(F.col("_hot"), place_among(F.col("_cuts"), value, 1 << 20)).otherwise(F.lit(0)).cast("bigint")
    joined = joined.withColumn("_place", place)
    for span in (FAN, 1):
        nodes, above = F.broadcast(cut_nodes(cuts, names, span)), F.col("_place") - 1
        joined = joined.drop("_cuts", *names).join(nodes, same & (F.col("_node") == above), "left").drop("_node")
        place = above * FAN + place_among(F.col("_cuts"), value, FAN)
        joined = joined.withColumn("_place", F.when(F.col("_cuts").isNotNull(), place).otherwise(F.lit(0)))
    bucket = F.col("_place") * PARTS
    if split_copies:
        cut = F.get("_cuts", F.pmod(F.col("_place") - 1, F.lit(FAN)).cast("int"))
        many = F.coalesce(cut["parts"] > 1, F.lit(False))
        copy = cut["p"].eqNullSafe(F.col(position)) & cut["t"].eqNullSafe(F.col(tie))
        part = F.when(copy, F.pmod(F.monotonically_increasing_id(), cut["parts"])).otherwise(cut["parts"])
        bucket = bucket + F.when(many, part).otherwise(F.lit(0))
    return joined.withColumn("_bucket", bucket).drop("_cuts", "_place", *names)


def inherited_maximum(cut: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per bucket of a hot key with the largest value before it."""
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.filter("_hot")
        .groupBy(*keys, "_bucket")
        .agg(F.max(value).alias("_max"))
        .select(*keys, "_bucket", F.max("_max").over(earlier).alias(value))
    )


def prior_maximum(
    cut: DataFrame,
    inherited: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str = "prior_max",
) -> DataFrame:
    """Largest `value` of the rows before this one in its key, by `order`.

    What a bucket inherits enters it as an extra first row, so the rows are
    shuffled once, by (key, bucket), and joined with nothing.
    """
    both = cut.withColumn("_row", F.lit(1)).unionByName(
        inherited.withColumn("_row", F.lit(0)), allowMissingColumns=True
    )
    within = (
        W.partitionBy(*keys, "_bucket")
        .orderBy("_row", *order)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        both.withColumn(out, F.max(value).over(within))
        .filter(F.col("_row") == 1)
        .drop("_bucket", "_row", "_hot")
    )


# ------------------------------------------------------------- SCD-2 intervals

_FOREVER = 9_223_372_036_854_775_807


def _instant(df: DataFrame, column: str) -> Column:
    return instant_micros(F.col(column), df.schema[column].dataType)


def interval_frame(
    df: DataFrame,
    key: str | Sequence[str],
    valid_from: str,
    valid_to: str,
    current: str | None = None,
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Distinct intervals per key with their row count `n`, the furthest end seen
    before them (`prior_max`) and whether they are open. An end of null is open.
    Copies of an interval collapse before they are sorted."""
    keys = [key] if isinstance(key, str) else list(key)
    flag = F.col(valid_to).isNull() if current is None else F.col(current).cast("boolean")
    lines = df.select(
        *keys,
        _instant(df, valid_from).alias("start"),
        F.coalesce(_instant(df, valid_to), F.lit(_FOREVER)).alias("end"),
        F.coalesce(flag, F.lit(False)).alias("open"),
    )
    # A row without a start has no place on the line: it ends nothing earlier.
    reach = F.when(F.col("start").isNotNull(), F.col("end"))
    cut = with_bucket(lines, keys, "start", "end", hot_rows, bucket_rows).withColumn("_end", reach)
    distinct = cut.groupBy(*keys, "_bucket", "start", "end", "open", "_end").agg(rows().alias("n"))
    return prior_maximum(
        distinct, inherited_maximum(cut, keys, "_end"), keys, ["start", "end", "open"], "_end"
    ).drop("_end")


def scd2_rows(
    df: DataFrame, key: str | Sequence[str], valid_from: str, valid_to: str, current: str | None = None
) -> DataFrame:
    """Distinct intervals with something wrong: keys, both ends, `copies` and `problems`
    (overlap, gap, inverted, several open)."""
    keys = [key] if isinstance(key, str) else list(key)
    frame = interval_frame(df, keys, valid_from, valid_to, current)
    opened = frame.groupBy(*[F.col(k).alias(f"_o_{k}") for k in keys])
    opened = opened.agg(F.sum(F.when(F.col("open"), F.col("n"))).alias("_open")).filter("_open > 1")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    start, end, prior = F.col("start"), F.col("end"), F.col("prior_max")
    wrong = {
        "overlap": (prior > start) | ((end > start) & (F.col("n") > 1)),
        "gap": prior < start,
        "inverted": start.isNull() | (start >= end),
        "several open": F.col("open") & F.col("_open").isNotNull(),
    }
    ends = [
        (F.when(v < _FOREVER, v) if isinstance(df.schema[c].dataType, T.NumericType) else from_epoch_micros(F.when(v < _FOREVER, v))).alias(c)
        for v, c in ((start, valid_from), (end, valid_to))
    ]
    out = frame.join(opened, same, "left").filter(reduce(lambda a, b: a | b, wrong.values()))
    return out.select(*keys, *ends, F.col("n").alias("copies"), names_where(wrong.items()).alias("problems"))


def scd2_measurement(
    df: DataFrame,
    key: str | Sequence[str],
    valid_from: str,
    valid_to: str,
    current: str | None = None,
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> Measurement:
    keys = [key] if isinstance(key, str) else list(key)
    frame = interval_frame(df, keys, valid_from, valid_to, current, hot_rows, bucket_rows)
    start, end, prior, n = (F.col(c) for c in ("start", "end", "prior_max", "n"))
    copies_overlap = F.when(end > start, n - 1).otherwise(F.lit(0))
    overlaps = F.when(prior > start, n).otherwise(copies_overlap)
    # Combined per key first (map side), so that a hot key costs one row per task.
    per_key = frame.groupBy(*keys).agg(
        F.sum(F.when(start.isNull(), F.lit(0)).otherwise(overlaps)).alias("overlaps"),
        F.count_if(prior < start).alias("gaps"),
        F.sum(F.when(start.isNull() | (start >= end), n).otherwise(0)).alias("inverted"),
        F.sum(F.when(F.col("open"), n).otherwise(0)).alias("open_rows"),
        F.sum(n).alias("n"),
    )

    def judge(m: Any) -> Judgement:
        bad = m("overlaps") + m("gaps") + m("inverted") + m("multi_open")
        return Judgement(
            violations=bad,
            passed=zero(bad),
            observed=bad,
            expected=F.lit(0),
            metrics={
                "overlaps": m("overlaps"),
                "gaps": m("gaps"),
                "inverted": m("inverted"),
                "keys_with_several_open_rows": m("multi_open"),
                "total_rows": m("total"),
            },
        )

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return Measurement(
        per_key,
        {
            "overlaps": total("overlaps"),
            "gaps": total("gaps"),
            "inverted": total("inverted"),
            "multi_open": F.count_if(F.col("open_rows") > 1),
            "total": total("n"),
        },
        judge,
    )


def check_scd2(
    df: DataFrame,
    key: str | Sequence[str],
    valid_from: str,
    valid_to: str,
    current: str | None = None,
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    **label: Any,
) -> DataFrame:
    m = scd2_measurement(df, key, valid_from, valid_to, current, hot_rows, bucket_rows)
    return result("scd2", m, **label)


# ---------------------------------------------------------------- late arrivals


def lateness_judgement(late: Column, total: Column, max_rate: float) -> Judgement:
    rate = F.when(total > 0, late / total).otherwise(F.lit(0.0))
    ok = rate <= max_rate
    return Judgement(
        violations=F.when(ok, 0).otherwise(late),
        passed=ok,
        observed=rate,
        expected=F.lit(0),
        tolerance=F.lit(max_rate),
        metrics={"late_rows": late, "total_rows": total, "late_rate": rate},
    )


def is_late(event_us: Column, arrival_us: Column, sla_seconds: int) -> Column:
    return arrival_us - event_us > F.lit(sla_seconds * 1_000_000)


def late_rows(df: DataFrame, event_ts: str, arrival_ts: str, sla_seconds: int) -> DataFrame:
    return df.filter(is_late(_instant(df, event_ts), _instant(df, arrival_ts), sla_seconds))


def late_measurement(
    df: DataFrame,
    event_ts: str | Column,
    arrival_ts: str,
    sla_seconds: int,
    max_rate: float = 0.0,
) -> Measurement:
    """`event_ts` may be an NTZ expression, e.g. a time read from a payload."""
    e = _instant(df, event_ts) if isinstance(event_ts, str) else epoch_micros(event_ts)
    late = is_late(e, _instant(df, arrival_ts), sla_seconds)
    return Measurement(
        df,
        {"late": count_if(late), "total": F.count_if(late.isNotNull())},
        lambda m: lateness_judgement(m("late"), m("total"), max_rate),
    )


def check_late_arrivals(
    df: DataFrame,
    event_ts: str,
    arrival_ts: str,
    sla_seconds: int,
    max_rate: float = 0.0,
    **label: Any,
) -> DataFrame:
    m = late_measurement(df, event_ts, arrival_ts, sla_seconds, max_rate)
    return result("late_arrivals", m, **label)


def behind_running_max(
    df: DataFrame,
    event_ts: str,
    arrival_order: str,
    partition: str | Sequence[str],
    sla_seconds: int = 0,
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Late rows when only the order of arrival is known: the event lies more
    than the SLA behind the newest event that arrived before it from the same
    partition. Rows with equal arrival order are ordered by event time."""
    keys = [partition] if isinstance(partition, str) else list(partition)
    position = _instant(df, arrival_order)
    timed = df.withColumns({"_us": _instant(df, event_ts), "_pos": position})
    cut = with_bucket(timed, keys, "_pos", "_us", hot_rows, bucket_rows, split_copies=True)
    out = prior_maximum(
        cut, inherited_maximum(cut, keys, "_us"), keys, [arrival_order, "_us"], "_us", "_newest"
    )
    behind = F.col("_newest") - F.col("_us")
    return (
        out.withColumn("late", F.coalesce(behind > sla_seconds * 1_000_000, F.lit(False)))
        .withColumn("seconds_behind", F.greatest(F.lit(0), behind) / 1_000_000)
        .drop("_us", "_pos", "_newest")
    )


def running_late_measurement(
    df: DataFrame,
    event_ts: str,
    arrival_order: str,
    partition: str | Sequence[str],
    sla_seconds: int = 0,
    max_rate: float = 0.0,
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
) -> Measurement:
    frame = behind_running_max(
        df, event_ts, arrival_order, partition, sla_seconds, hot_rows, bucket_rows
    )
    return Measurement(
        frame,
        {"late": F.count_if("late"), "total": rows()},
        lambda m: lateness_judgement(m("late"), m("total"), max_rate),
    )


def check_late_by_order(
    df: DataFrame,
    event_ts: str,
    arrival_order: str,
    partition: str | Sequence[str],
    sla_seconds: int = 0,
    max_rate: float = 0.0,
    hot_rows: int = HOT_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    **label: Any,
) -> DataFrame:
    m = running_late_measurement(
        df, event_ts, arrival_order, partition, sla_seconds, max_rate, hot_rows, bucket_rows
    )
    return result("late_arrivals", m, **label)
