import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecheck.spec import Check, Suite
from tablecheck.streaming import checks as Z

SCHEMA = "id int, k string, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, frame, tmp_path):
    """Writes each list of rows as one file and streams one file per batch."""

    def make(*batches):
        for i, rows in enumerate(batches):
            frame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for i in range(len(batches)):
            for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
                import os

                os.utime(f, (1_700_000_000 + i * 100,) * 2)
        return (
            spark.readStream.schema(frame([], SCHEMA).schema)
            .option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True)
            .parquet(f"{tmp_path}/in")
        )

    return make


def test_suite_per_batch(spark, feed, tmp_path):
    stream = feed([(1, "a", at(0)), (1, "b", at(1))], [(2, "c", at(2))])
    suite = Suite("s", [Check("u", "uniqueness", "events", keys=["id"]), Check("n", "not_null", "events", keys=["k"])])
    seen = {}

    def sink(results, batch_id):
        seen[batch_id] = {r.test: (r.status, r.run_id) for r in results.collect()}

    Z.stream_checks(stream, "events", suite, sink, f"{tmp_path}/ck").awaitTermination()
    assert seen[0]["u"] == ("fail", "batch-0") and seen[1]["u"] == ("pass", "batch-1")
    assert seen[0]["n"][0] == "pass"


def test_windows_across_batches(spark, feed, tmp_path):
    stream = feed([(1, "a", at(0)), (2, "a", at(50))], [(3, "a", at(10)), (4, "b", at(70))])
    frame = Z.window_counts(stream, "ts", "2 hours", "1 hour", by=["k"])
    Z.update_to(frame, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r.window_start, r.k): r.n for r in Z.latest(spark, f"{tmp_path}/out", ["window_start", "window_end", "k"]).collect()}
    assert got == {(at(0), "a"): 3, (at(60), "b"): 1}


def test_closed_windows_only(spark, feed, tmp_path):
    stream = feed([(1, "a", at(0)), (2, "a", at(61))], [(3, "a", at(200))], [(5, "a", at(201))], [(4, "a", at(5))])
    frame = Z.window_counts(stream, "ts", "10 minutes", "1 hour")
    Z.append_to(frame, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {r.window_start: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {at(0): 1, at(60): 1}  # row 4 comes after its window was closed


def test_duplicates_within_watermark(spark, feed, tmp_path):
    stream = feed([(1, "a", at(0)), (1, "a", at(1))], [(1, "a", at(2)), (2, "b", at(3))])
    Z.append_to(Z.first_seen(stream, "ts", "1 hour", ["id"]), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_sessions(spark, feed, tmp_path):
    stream = feed([(1, "a", at(0)), (2, "a", at(5)), (3, "a", at(60))], [(4, "a", at(500))])
    frame = Z.sessions(stream, "ts", "1 minute", "10 minutes", ["k"])
    Z.append_to(frame, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r.session_start, r.session_end, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(at(0), at(15), 2), (at(60), at(70), 1)}


def test_lateness_against_earlier_batches(spark, feed, tmp_path):
    stream = feed([(1, "a", at(100)), (2, "a", at(0))], [(3, "a", at(30)), (4, "a", at(95))], [(5, "a", at(300))])
    seen = {}

    def sink(counts, batch_id):
        seen[batch_id] = tuple(counts.first())

    Z.batch_lateness(stream, "ts", 3600, sink, f"{tmp_path}/ck", f"{tmp_path}/store").awaitTermination()
    assert seen == {0: (0, 2, 0), 1: (1, 2, 1), 2: (2, 1, 0)}


def test_late_counts(spark, feed, tmp_path):
    stream = feed([(1, "a", at(0)), (2, "a", at(1))]).withColumn(
        "arrival", F.expr("ts + make_dt_interval(0, 0, id * 10, 0)")
    )
    frame = Z.late_counts(stream, "ts", "arrival", 900, "1 hour", "1 hour")
    Z.update_to(frame, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    r = Z.latest(spark, f"{tmp_path}/out", ["window_start", "window_end"]).first()
    assert (r.n, r.late) == (2, 1)


def test_silence(spark, feed, tmp_path):
    stream = feed([(1, "a", at(0)), (2, "a", at(5)), (3, "b", at(500))], [(4, "b", at(501))])
    frame = Z.silence_alarms(stream, "ts", "1 minute", "1 hour", ["k"])
    Z.append_to(frame, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "last_seen", "alarm_at", "n").collect()]
    assert got == [("a", at(5), at(65), 2)]


def _finish(spark, frame, path, as_of):
    schema = frame([], SCHEMA).schema
    return lambda out: Z.finish(
        spark, lambda: Z.append_to(out, f"{path}/out", f"{path}/ck"), f"{path}/marks", schema, "ts", as_of, "1 minute"
    )


def test_finish_reports_the_last_session_and_silence(spark, frame, feed, tmp_path):
    # Several batches: the mark must not make rows of a later file late.
    stream = feed([(1, "a", at(0)), (2, "b", at(3))], [(3, "a", at(5)), (4, "a", at(100))], [(5, "b", at(50))])
    alarms = Z.silence_alarms(stream, "ts", "1 hour", "20 minutes", ["k"], f"{tmp_path}/marks")
    _finish(spark, frame, tmp_path, at(200))(alarms)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "last_seen", "alarm_at", "n").collect()}
    assert got == {("a", at(5), at(25), 2), ("a", at(100), at(120), 1), ("b", at(3), at(23), 1), ("b", at(50), at(70), 1)}


def test_finish_leaves_open_what_ends_later(spark, frame, feed, tmp_path):
    stream = feed([(1, "a", at(0)), (2, "a", at(100)), (3, None, at(100))])
    out = Z.sessions(stream, "ts", "1 minute", "10 minutes", ["k"], f"{tmp_path}/marks")
    run = _finish(spark, frame, tmp_path, at(105))
    run(out)
    read = lambda: {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "session_end", "n").collect()}
    assert read() == {("a", at(10), 1)}
    _finish(spark, frame, tmp_path, at(110))(out)
    assert read() == {("a", at(10), 1), ("a", at(110), 1), (None, at(110), 1)}


def test_finish_of_an_empty_stream(spark, frame, feed, tmp_path):
    out = Z.sessions(feed([]), "ts", "1 minute", "10 minutes", ["k"], f"{tmp_path}/marks")
    _finish(spark, frame, tmp_path, at(10))(out)
    assert spark.read.schema(out.schema).parquet(f"{tmp_path}/out").count() == 0
