"""Checks on the events table read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tablecheck.plans.lineage import ensure_checkpoint_dir
from tablecheck.spec import Check, Suite
from tablecheck.streaming import checks as Z

from .base import AS_OF, Tables, query


def _scratch(t: Tables) -> str:
    """A new folder in the shared checkpoint folder of the cluster."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/streams/{uuid.uuid4()}"


def _stream(t: Tables) -> DataFrame:
    return (
        t.spark.readStream.schema(t.events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.folder)
    )


def _appended(t: Tables, frame: DataFrame) -> DataFrame:
    at = _scratch(t)
    Z.append_to(frame, f"{at}/out", f"{at}/ck").awaitTermination()
    return t.spark.read.schema(frame.schema).parquet(f"{at}/out")


def _updated(t: Tables, frame: DataFrame, keys: list[str]) -> DataFrame:
    at = _scratch(t)
    Z.update_to(frame, f"{at}/out", f"{at}/ck").awaitTermination()
    return Z.latest(t.spark, f"{at}/out", keys)


@query(
    "stream_windows",
    """
    SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS window_end,
           event_type, count(*) AS n, count(*) FILTER (value > 40) AS high FROM events GROUP BY ALL
    """,
)
def stream_windows(t: Tables) -> DataFrame:
    frame = Z.window_counts(
        _stream(t), "ts", "1 hour", "6 hours", by=["event_type"], measures={"high": F.count_if(F.col("value") > 40)}
    )
    return _updated(t, frame, ["window_start", "window_end", "event_type"])


@query(
    "stream_windows_closed",
    """
    WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, n FROM w
    WHERE window_start + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR
    """,
)
def stream_windows_closed(t: Tables) -> DataFrame:
    return _appended(t, Z.window_counts(_stream(t), "ts", "1 hour", "1 day", by=["event_type"]))


@query(
    "stream_windows_sliding",
    """
    WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(6 * k AS INTEGER)) AS window_start, event_type
               FROM events, (SELECT unnest([0, 1]) AS k))
    SELECT window_start, window_start + INTERVAL 12 HOUR AS window_end, event_type, count(*) AS n FROM w GROUP BY ALL
    """,
)
def stream_windows_sliding(t: Tables) -> DataFrame:
    frame = Z.window_counts(_stream(t), "ts", "1 hour", "12 hours", "6 hours", by=["event_type"])
    return _updated(t, frame, ["window_start", "window_end", "event_type"])


@query(
    "stream_dedup",
    "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
)
def stream_dedup(t: Tables) -> DataFrame:
    s = _stream(t).withColumn("day", F.to_date("ts"))
    return _appended(
        t, Z.first_seen(s, "ts", "1 day", ["user_id", "event_type", "day"]).select("user_id", "event_type", "day")
    )


@query(
    "stream_late",
    """
    WITH e AS (SELECT event_type, ts, ts + to_minutes(CAST(event_id % 10 AS INTEGER)) AS arrival FROM events)
    SELECT time_bucket(INTERVAL 1 DAY, arrival, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 DAY, arrival, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end,
           event_type, count(*) AS n, count(*) FILTER (arrival - ts > INTERVAL 5 MINUTE) AS late FROM e GROUP BY ALL
    """,
)
def stream_late(t: Tables) -> DataFrame:
    s = _stream(t).withColumn("arrival", F.expr("ts + make_dt_interval(0, 0, CAST(event_id % 10 AS INT), 0)"))
    frame = Z.late_counts(s, "ts", "arrival", 300, "1 hour", "1 day", by=["event_type"])
    return _updated(t, frame, ["window_start", "window_end", "event_type"])


@query(
    "stream_sessions",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 8 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
         a AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 8 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid)
    SELECT * FROM a WHERE session_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR
    """,
)
def stream_sessions(t: Tables) -> DataFrame:
    return _appended(t, Z.sessions(_stream(t), "ts", "1 hour", "8 hours", ["user_id"]))


@query(
    "stream_silence",
    """
    WITH g AS (SELECT event_type, user_id % 20 AS source, ts FROM events),
         l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 3 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY event_type, source ORDER BY ts)),
         s AS (SELECT *, sum(new) OVER (PARTITION BY event_type, source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l),
         a AS (SELECT event_type, source, max(ts) AS last_seen, max(ts) + INTERVAL 3 HOUR AS alarm_at, count(*) AS n FROM s GROUP BY event_type, source, sid)
    SELECT * FROM a WHERE alarm_at <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR
    """,
)
def stream_silence(t: Tables) -> DataFrame:
    s = _stream(t).withColumn("source", F.col("user_id") % 20)
    return _appended(t, Z.silence_alarms(s, "ts", "1 hour", "3 hours", ["event_type", "source"]))


def _finished(t: Tables, make, as_of: str) -> DataFrame:
    """`make(stream, marks)` over all rows, then with the clock at `as_of`."""
    at = _scratch(t)
    frame = make(_stream(t), f"{at}/marks")

    def start():
        return Z.append_to(frame, f"{at}/out", f"{at}/ck")

    Z.finish(t.spark, start, f"{at}/marks", t.events.schema, "ts", as_of, "1 hour")
    return t.spark.read.schema(frame.schema).parquet(f"{at}/out")


@query(
    "stream_sessions_finished",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 8 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 8 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, sid
    """,
)
def stream_sessions_finished(t: Tables) -> DataFrame:
    return _finished(t, lambda s, marks: Z.sessions(s, "ts", "1 hour", "8 hours", ["user_id"], marks), "2100-01-01 00:00:00")


@query(
    "stream_silence_due",
    f"""
    WITH g AS (SELECT event_type, user_id % 20 AS source, ts FROM events),
         l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 3 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY event_type, source ORDER BY ts)),
         s AS (SELECT *, sum(new) OVER (PARTITION BY event_type, source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l),
         a AS (SELECT event_type, source, max(ts) AS last_seen, max(ts) + INTERVAL 3 HOUR AS alarm_at, count(*) AS n FROM s GROUP BY event_type, source, sid)
    SELECT * FROM a WHERE alarm_at <= greatest(TIMESTAMP '{AS_OF}', (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR)
    """,
)
def stream_silence_due(t: Tables) -> DataFrame:
    def make(s: DataFrame, marks: str) -> DataFrame:
        s = s.withColumn("source", F.col("user_id") % 20)
        return Z.silence_alarms(s, "ts", "1 hour", "3 hours", ["event_type", "source"], marks)

    return _finished(t, make, AS_OF)


@query(
    "stream_suite",
    """
    SELECT 'value_positive' AS test, CASE WHEN count(*) FILTER (NOT value > 1) > 0 THEN 'fail' ELSE 'pass' END AS status, count(*) FILTER (NOT value > 1) AS violations FROM events
    UNION ALL SELECT 'ids', CASE WHEN count(*) FILTER (event_id IS NULL) > 0 THEN 'fail' ELSE 'pass' END, count(*) FILTER (event_id IS NULL) FROM events
    UNION ALL SELECT 'props', CASE WHEN count(*) FILTER (NOT json_valid(props)) > 0 THEN 'fail' ELSE 'pass' END, count(*) FILTER (NOT json_valid(props)) FROM events
    """,
)
def stream_suite(t: Tables) -> DataFrame:
    suite = Suite(
        "stream",
        [
            Check("value_positive", "rule", "events", expression="value > 1"),
            Check("ids", "not_null", "events", keys=["event_id"]),
            Check("props", "json_valid", "events", params={"payload": "props"}),
        ],
    )
    at = _scratch(t)

    def sink(results: DataFrame, batch_id: int) -> None:
        results.write.mode("overwrite").parquet(f"{at}/out/batch_id={batch_id}")

    Z.stream_checks(_stream(t), "events", suite, sink, f"{at}/ck", as_of=AS_OF).awaitTermination()
    return t.spark.read.parquet(f"{at}/out").select("test", "status", "violations")


@query(
    "stream_batch_lateness",
    """
    WITH e AS (SELECT event_id % 4 AS batch_id, ts FROM events),
         b AS (SELECT batch_id, max(ts) AS newest FROM e GROUP BY batch_id),
         s AS (SELECT batch_id, max(newest) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b)
    SELECT batch_id::BIGINT AS batch_id, count(*) AS n, count(*) FILTER (seen - ts > INTERVAL 1 HOUR) AS late
    FROM e JOIN s USING (batch_id) GROUP BY ALL
    """,
)
def stream_batch_lateness(t: Tables) -> DataFrame:
    """All events arrive in four loads, one after the other on the same checkpoint."""
    at = _scratch(t)

    def sink(counts: DataFrame, batch_id: int) -> None:
        counts.withColumnRenamed("batch_id", "batch").write.mode("overwrite").parquet(f"{at}/out/part={batch_id}")

    for load in range(4):
        t.events.filter(F.col("event_id") % 4 == load).write.mode("append").parquet(f"{at}/in")
        stream = t.spark.readStream.schema(t.events.schema).parquet(f"{at}/in")
        Z.batch_lateness(stream, "ts", 3600, sink, f"{at}/ck", f"{at}/store").awaitTermination()
    return t.spark.read.parquet(f"{at}/out").select(F.col("batch").alias("batch_id"), "n", "late")
