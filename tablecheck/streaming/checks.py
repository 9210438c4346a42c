"""The batch checks on a stream.

Event times are read as UTC whatever the session zone is: Spark's watermarks need
`timestamp`, the tables carry `timestamp_ntz`.  State is bounded by watermarks
(windows, duplicates, sessions); nothing is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.times import epoch_micros, from_epoch_micros, instant_micros, moment
from ..plans.suite import run_suite
from ..sources.local import local_frame
from ..spec import Suite

EVENT_TIME = "_event_time"
CLOSING = "_closing"


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Adds the watermarked `_event_time`."""
    c = F.col(ts)
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        c = F.timestamp_micros(epoch_micros(c))
    return stream.withColumn(EVENT_TIME, c).withWatermark(EVENT_TIME, delay)


def as_ntz(c: Column) -> Column:
    return from_epoch_micros(F.unix_micros(c))


def stream_checks(
    stream: DataFrame,
    dataset: str,
    suite: Suite,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    tables: dict[str, DataFrame] | None = None,
    as_of: Any = None,
    trigger: dict[str, Any] | None = None,
) -> Any:
    """Run a suite on every micro-batch; `sink(results, batch_id)` stores them.

    `run_id` is the batch number, so a batch that is repeated after a failure
    can replace its earlier results.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            results = run_suite(
                batch.sparkSession,
                suite,
                {**(tables or {}), dataset: batch},
                as_of=as_of,
                run_id=f"batch-{batch_id}",
            )
            sink(results, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def window_counts(
    stream: DataFrame,
    ts: str,
    delay: str,
    length: str,
    slide: str | None = None,
    by: Sequence[str] = (),
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Quality counts per tumbling or sliding window."""
    timed = with_event_time(stream, ts, delay)
    window = F.window(EVENT_TIME, length, slide) if slide else F.window(EVENT_TIME, length)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [c.alias(name) for name, c in (measures or {}).items()]
    out = timed.groupBy(window.alias("w"), *by).agg(*aggs)
    return out.select(
        as_ntz(F.col("w.start")).alias("window_start"),
        as_ntz(F.col("w.end")).alias("window_end"),
        *by,
        "n",
        *(measures or {}),
    )


def first_seen(stream: DataFrame, ts: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """One row per key within the watermark."""
    timed = with_event_time(stream, ts, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop(EVENT_TIME)


def late_counts(
    stream: DataFrame,
    event_ts: str,
    arrival_ts: str,
    sla_seconds: int,
    delay: str,
    length: str,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows and late rows per window of arrival time."""
    from ..operators.intervals import is_late

    us = [instant_micros(F.col(c), stream.schema[c].dataType) for c in (event_ts, arrival_ts)]
    late = F.count_if(is_late(*us, sla_seconds))
    return window_counts(stream, arrival_ts, delay, length, by=by, measures={"late": late})


def _with_marks(stream: DataFrame, ts: str, marks: str) -> DataFrame:
    """Rows and the marks of `finish`, told apart by `_closing`; the newest of either
    moves the watermark that is declared on top."""
    spark = stream.sparkSession
    only = T.StructType([T.StructField(ts, stream.schema[ts].dataType)])
    local_frame(spark, [], only).write.mode("ignore").parquet(marks)
    times = spark.readStream.schema(only).parquet(marks).withColumn(CLOSING, F.lit(True))
    return stream.withColumn(CLOSING, F.lit(False)).unionByName(times, allowMissingColumns=True)


def _periods(
    stream: DataFrame, ts: str, delay: str, gap: str, by: Sequence[str], marks: str | None
) -> DataFrame:
    """Periods of activity per key. Marks are periods of their own and are dropped by an
    aggregated value: a filter on the key would reach the scan, and with it the marks
    would be gone before the watermark sees them."""
    if marks is None:
        stream = stream.withColumn(CLOSING, F.lit(False))
    else:
        stream = _with_marks(stream, ts, marks)
    timed = with_event_time(stream, ts, delay)
    out = timed.groupBy(F.session_window(EVENT_TIME, gap).alias("w"), *by, CLOSING).agg(
        F.max(EVENT_TIME).alias("_last"), F.count(F.lit(1)).alias("n"), F.bool_or(CLOSING).alias("_mark")
    )
    return out.filter(~F.col("_mark"))


def sessions(
    stream: DataFrame, ts: str, delay: str, gap: str, by: Sequence[str], marks: str | None = None
) -> DataFrame:
    """Periods of activity per key; the time between two of them is a gap longer
    than `gap`. With `marks`, `finish` also closes those that are still open."""
    out = _periods(stream, ts, delay, gap, by, marks)
    return out.select(
        *by,
        as_ntz(F.col("w.start")).alias("session_start"),
        as_ntz(F.col("w.end")).alias("session_end"),
        "n",
    )


def silence_alarms(
    stream: DataFrame, ts: str, delay: str, sla: str, by: Sequence[str], marks: str | None = None
) -> DataFrame:
    """Freshness per key: one alarm whenever a key has been silent for `sla`.

    A session with the SLA as its gap closes exactly then, so the timers are
    Spark's own and rows of a hot key are merged before the shuffle where
    spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition is on.
    Rows alone move the watermark no further than the newest of them; with
    `marks`, `finish` also gives the alarms of keys that stay silent to the end.
    """
    out = _periods(stream, ts, delay, sla, by, marks)
    return out.select(
        *by,
        as_ntz(F.col("_last")).alias("last_seen"),
        as_ntz(F.col("w.end")).alias("alarm_at"),
        "n",
    )


def finish(
    spark: SparkSession, start: Callable[[], Any], marks: str, schema: T.StructType, ts: str, as_of: Any, delay: str
) -> None:
    """Read everything there is, then let the clock reach `as_of`.

    `start()` starts the query over sessions or alarms that were given the folder
    `marks`, each time on the same checkpoint. It runs once for the rows. Then one mark
    with the time `as_of` + `delay` is written, so that the watermark becomes `as_of`,
    and it runs again: whatever ends by `as_of` is final, later ends stay open. Rows
    that arrive afterwards and lie before `as_of` count as late. Calling it again with
    the same or a later `as_of` goes on from there; after a failure it is repeated.
    """
    start().awaitTermination()
    at = moment(as_of) + F.expr(f"INTERVAL {delay}")
    spark.range(1).select(at.cast(schema[ts].dataType).alias(ts)).write.mode("append").parquet(marks)
    start().awaitTermination()


def batch_lateness(
    stream: DataFrame,
    ts: str,
    sla_seconds: int,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    store: str,
    trigger: dict[str, Any] | None = None,
) -> Any:
    """Share of rows per micro-batch that lie more than the SLA behind the newest
    event of EARLIER batches. The newest time per batch is written to `store`
    under its batch number, so a repeated batch gives the same answer."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        us = instant_micros(F.col(ts), batch.schema[ts].dataType)
        seen = 0
        if batch_id > 0:
            row = (
                spark.read.schema("newest bigint, batch_id bigint")
                .parquet(store)
                .filter(F.col("batch_id") < batch_id)
                .agg(F.max("newest").alias("newest"))
                .first()
            )
            seen = row.newest or 0
        behind = F.lit(seen) - us > sla_seconds * 1_000_000
        late = F.count_if(behind) if seen else F.count_if(F.lit(False))
        counted = batch.agg(
            F.count(F.lit(1)).alias("n"), late.alias("late"), F.max(us).alias("newest")
        ).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        row = counted.first()
        result = local_frame(spark, [tuple(row)], counted.schema)
        result.select("newest", "batch_id").write.mode("overwrite").parquet(
            f"{store}/part={batch_id}"
        )
        sink(result.select("batch_id", "n", "late"), batch_id)

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


# ----------------------------------------------------------------------- sinks


def append_to(frame: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> Any:
    """Final rows only (windows and sessions that the watermark closed)."""
    return (
        frame.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def update_to(frame: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> Any:
    """Every change of a group, one folder per batch; `latest` reads the result.
    Open windows are included, and a repeated batch replaces its own folder."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        frame.writeStream.outputMode("update")
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest(spark: Any, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest state of every group written by `update_to`."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in keys and c != "batch_id"]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.col("batch_id")).alias("v"))
        .select(*keys, "v.*")
    )
