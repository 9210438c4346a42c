"""Suites, gates, samples, run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.operators.evidence import EvidenceTolerance, EvidenceWindow, Manifest
from tablecheck.plans import history as H, suite as S
from tablecheck.spec import Check, DatasetMeta, Filter, Suite, Tolerance, Window

from .base import AS_OF, Tables, query

SUITE = Suite(
    "nightly",
    [
        Check("pk_orders", "uniqueness", "orders", keys=["o_orderkey"], severity="blocker"),
        Check("pk_lineitem", "uniqueness", "lineitem", keys=["l_orderkey", "l_linenumber"], severity="blocker"),
        Check("keys_present", "not_null", "orders", keys=["o_orderkey", "o_custkey"], severity="blocker"),
        Check("price_positive", "rule", "orders", expression="o_totalprice > 2000"),
        Check("status_known", "allowed_values", "orders", params={"column": "o_orderstatus", "values": ["F", "O"]}, gate="warn"),
        Check("orders_enough", "row_count", "orders", params={"min": 10, "max": 1000}, severity="minor", gate="warn"),
        Check("urgent_1996", "invariant", "orders", expression="o_totalprice < 400000",
              filters=[Filter("o_orderpriority", "equals", "1-URGENT")],
              window=Window(start_date="1996-01-01", end_date="1997-01-01"), params={"watermark": "o_orderdate"}),
        Check("fk_orders", "foreign_key", "lineitem", keys=["l_orderkey"], params={"parent": "orders_dear", "ref_columns": ["o_orderkey"]}),
        Check("fk_customer", "reconciliation", "orders", keys=["o_custkey"], params={"parent": "customer", "ref_columns": ["c_custkey"]}),
        Check("discount_rule", "rule", "lineitem", expression="l_tax == l_discount", tolerance=Tolerance(abs=0.05)),
        Check("balance", "invariant", "customer", expression="c_acctbal >= 0", severity="minor", gate="warn"),
        Check("events_fresh", "freshness", "events", window=Window(last_hours=24)),
        Check("events_week", "row_count", "events", window=Window(last_days=7), params={"min": 1}),
        Check("props_valid", "json_valid", "events", params={"payload": "props"}),
        Check("props_k", "json_type", "events", params={"payload": "props", "path": "$.k", "expected": "NUMBER"}),
        Check("props_z", "json_path", "events", params={"payload": "props", "path": "$.z"}, gate="warn"),
        Check("evidence", "reconciliation", "events", params={
            "window": EvidenceWindow("ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00"),
            "manifest": Manifest("b1", 5000, {"DISTINCT(user_id)": 100}),
            "tolerance": EvidenceTolerance(0, 50.0, 50.0)}),
        Check("chars", "rule", "documents", expression="n_chars == length(text)"),
        Check("no_such_column", "not_null", "orders", keys=["o_missing"]),
        Check("switched_off", "not_null", "orders", keys=["o_custkey"], enabled=False),
    ],
)
_METAS = {"events": DatasetMeta("events", watermark_column="ts")}


def suite_tables(t: Tables) -> dict[str, DataFrame]:
    names = ("orders", "lineitem", "customer", "events", "documents")
    return {n: getattr(t, n) for n in names} | {"orders_dear": t.orders.filter("o_totalprice > 50000")}


def run(t: Tables, fuse: bool = True) -> DataFrame:
    return S.run_suite(t.spark, SUITE, suite_tables(t), AS_OF, "run-1", _METAS, fuse=fuse)


_COUNTS = """
v AS (
  SELECT 'pk_orders' AS test, 'uniqueness' AS type, 'orders' AS dataset, 'blocker' AS severity, 'fail' AS gate, (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS n UNION ALL
  SELECT 'pk_lineitem', 'uniqueness', 'lineitem', 'blocker', 'fail', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) UNION ALL
  SELECT 'keys_present', 'not_null', 'orders', 'blocker', 'fail', count(*) FILTER (o_orderkey IS NULL OR o_custkey IS NULL) FROM orders UNION ALL
  SELECT 'price_positive', 'rule', 'orders', 'major', 'fail', count(*) FILTER (NOT o_totalprice > 2000) FROM orders UNION ALL
  SELECT 'status_known', 'allowed_values', 'orders', 'major', 'warn', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL
  SELECT 'orders_enough', 'row_count', 'orders', 'minor', 'warn', greatest(0, 10 - count(*)) + greatest(0, count(*) - 1000) FROM orders UNION ALL
  SELECT 'urgent_1996', 'invariant', 'orders', 'major', 'fail', count(*) FILTER (NOT o_totalprice < 400000) FROM orders
    WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' UNION ALL
  SELECT 'fk_orders', 'foreign_key', 'lineitem', 'major', 'fail', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 50000) UNION ALL
  SELECT 'fk_customer', 'reconciliation', 'orders', 'major', 'fail', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
  SELECT 'discount_rule', 'rule', 'lineitem', 'major', 'fail', count(*) FILTER (abs(CAST(l_tax AS DECIMAL(18,4)) - CAST(l_discount AS DECIMAL(18,4))) > 0.05) FROM lineitem UNION ALL
  SELECT 'balance', 'invariant', 'customer', 'minor', 'warn', count(*) FILTER (c_acctbal < 0) FROM customer UNION ALL
  SELECT 'events_fresh', 'freshness', 'events', 'major', 'fail', greatest(0, date_diff('hour', max(ts), TIMESTAMP '2024-01-31') - 24) FROM events UNION ALL
  SELECT 'events_week', 'row_count', 'events', 'major', 'fail', greatest(0, 1 - count(*)) FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31' UNION ALL
  SELECT 'props_valid', 'json_valid', 'events', 'major', 'fail', count(*) FILTER (NOT json_valid(props)) FROM events UNION ALL
  SELECT 'props_k', 'json_type', 'events', 'major', 'fail', count(*) FILTER (json_type(props, '$.k') <> 'UBIGINT') FROM events UNION ALL
  SELECT 'props_z', 'json_path', 'events', 'major', 'warn', count(*) FILTER (NOT json_exists(props, '$.z')) FROM events UNION ALL
  SELECT 'evidence', 'reconciliation', 'events', 'major', 'fail', CASE WHEN abs(count(*) - 5000.0) / 5000 * 100 <= 50 THEN 0 ELSE 1 END + CASE WHEN abs(count(DISTINCT user_id) - 100.0) <= 50 THEN 0 ELSE 1 END
    FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' UNION ALL
  SELECT 'chars', 'rule', 'documents', 'major', 'fail', count(*) FILTER (abs(n_chars - length(text)) > 0.01) FROM documents
),
r AS (SELECT test, type, dataset, severity, gate, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(n AS BIGINT) AS violations FROM v
      UNION ALL SELECT 'no_such_column', 'not_null', 'orders', 'major', 'fail', 'error', NULL
      UNION ALL SELECT 'switched_off', 'not_null', 'orders', 'major', 'fail', 'skip', NULL)
"""

_RESULT_COLUMNS = ("test", "type", "dataset", "severity", "gate", "status", "violations")


@query("suite_results", f"WITH {_COUNTS} SELECT * FROM r")
def suite_results(t: Tables) -> DataFrame:
    return run(t).select(*_RESULT_COLUMNS)


@query("suite_results_unfused", f"WITH {_COUNTS} SELECT * FROM r")
def suite_results_unfused(t: Tables) -> DataFrame:
    """The same suite, one plan per check; must agree with the fused run."""
    return run(t, fuse=False).select(*_RESULT_COLUMNS)


@query(
    "suite_gate",
    f"""
    WITH {_COUNTS}, a AS (SELECT count(*) FILTER (status IN ('fail', 'error') AND gate = 'fail') AS f, count(*) FILTER (status IN ('fail', 'error') AND gate = 'warn') AS w,
                                 min(CASE WHEN status IN ('fail', 'error') THEN CASE severity WHEN 'blocker' THEN 1 WHEN 'major' THEN 2 ELSE 3 END END) AS s FROM r)
    SELECT 'run-1' AS run_id, 'nightly' AS suite, CASE WHEN f > 0 THEN 'fail' WHEN w > 0 THEN 'warn' ELSE 'pass' END AS verdict, f AS failures, w AS warnings,
           CASE s WHEN 1 THEN 'blocker' WHEN 2 THEN 'major' WHEN 3 THEN 'minor' END AS worst FROM a
    """,
)
def suite_gate(t: Tables) -> DataFrame:
    return S.gate(run(t))


@query(
    "suite_summary",
    f"""
    WITH {_COUNTS}
    SELECT 'run-1' AS run_id, 'nightly' AS suite_name, 'completed' AS status, count(*) AS total_tests, count(*) FILTER (status = 'pass') AS passed_tests,
           count(*) FILTER (status = 'fail') AS failed_tests, count(*) FILTER (status = 'error') AS error_tests, count(*) FILTER (status = 'skip') AS skipped_tests,
           CAST(61500 AS BIGINT) AS execution_time_ms FROM r
    """,
)
def suite_summary(t: Tables) -> DataFrame:
    out = S.run_summary(run(t), "2024-01-31 00:00:00", "2024-01-31 00:01:01.5")
    return out.drop("started_at", "ended_at", "environment", "connection")


_MASK = "CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) WHEN length({c}) <= 8 THEN substr({c}, 1, 2) || repeat('*', length({c}) - 4) || right({c}, 2) ELSE substr({c}, 1, 3) || repeat('*', length({c}) - 6) || right({c}, 3) END"


@query(
    "suite_samples",
    f"""
    WITH b AS (SELECT 'balance' AS _test, CAST(to_json({{'c_custkey': c_custkey, 'c_name': {_MASK.format(c="c_name")}, 'c_nationkey': c_nationkey}}) AS VARCHAR) AS row
               FROM customer WHERE c_acctbal < 0),
         d AS (SELECT 'pk_lineitem' AS _test, CAST(to_json({{'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'duplicate_count': count(*)}}) AS VARCHAR) AS row
               FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    (SELECT * FROM b ORDER BY row LIMIT 100) UNION ALL (SELECT * FROM d ORDER BY row LIMIT 100)
    """,
)
def suite_samples(t: Tables) -> DataFrame:
    suite = Suite(
        "samples",
        [
            Check("balance", "invariant", "customer", expression="NOT negative"),
            Check("pk_lineitem", "uniqueness", "lineitem", keys=["l_orderkey", "l_linenumber"]),
            Check("pk_orders", "uniqueness", "orders", keys=["o_orderkey"]),
        ],
    )
    tables = suite_tables(t)
    # `negative` is only there for the rule; the sample shows the other columns.
    tables["customer"] = t.customer.select(
        "c_custkey", "c_name", "c_nationkey", (F.col("c_acctbal") < 0).alias("negative")
    )
    results = S.run_suite(t.spark, suite, tables, AS_OF, "run-1")
    out = S.sample_violations(t.spark, suite, results, tables, as_of=AS_OF)
    return out.withColumn("row", F.regexp_replace("row", ',"negative":true', ""))


_KINDS = {
    "json_enum": "json_extract_string(props, '$.k') NOT IN ('1', '2', '3')",
    "json_mapping": "json_extract_string(props, '$.k') <> CAST(user_id AS VARCHAR)",
    "json_type": "json_type(props, '$.k') NOT IN ('VARCHAR')",
    "late_arrivals": "event_id % 7 = 0",
}


@query(
    "suite_samples_kinds",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS _test, least(30, count(*)) AS n, min(CAST(event_id AS VARCHAR)) AS first FROM events WHERE {bad}"
        for kind, bad in _KINDS.items()
    )
    + """
    UNION ALL SELECT 'json_unique', least(30, count(*)), min(k) FROM (SELECT json_extract_string(props, '$.k') AS k FROM events GROUP BY 1 HAVING count(*) > 1 AND k IS NOT NULL)
    UNION ALL SELECT 'json_drift', count(*), min(k) FROM (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events)
    UNION ALL SELECT 'fact_coverage', least(30, count(*)), min(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'agg_match', count(*), min(o_orderstatus) FROM (SELECT o_orderstatus FROM orders GROUP BY 1 HAVING sum(o_custkey) <> sum(o_custkey + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END))
    UNION ALL SELECT 'evidence', 1, 'rowcount'
    UNION ALL SELECT 'schema', 1, 'no_such'
    UNION ALL SELECT 'row drift', least(30, count(*)), min(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'scd2', least(30, count(*)), min(CAST(c AS VARCHAR)) FROM (
        SELECT o_custkey AS c, o_orderdate AS s, max(o_orderdate + INTERVAL 30 DAY) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n
        FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)) WHERE before <> s
    """,
)
def suite_samples_kinds(t: Tables) -> DataFrame:
    """How many rows each failing check shows, at most 30, and the first of them."""
    from tablecheck.operators.evidence import Manifest

    tables = {
        "events": t.events.withColumn("arrived", F.expr("ts + make_dt_interval(0, 0, IF(event_id % 7 = 0, 9, 1), 0)")),
        "orders": t.orders.withColumn("until", F.expr("o_orderdate + make_dt_interval(30, 0, 0, 0)")),
        "rich": t.customer.filter("c_acctbal > 0"),
        "other": t.orders.withColumn("o_custkey", F.expr("o_custkey + IF(o_orderstatus = 'F', 0, 1)")),
        "no_keys": t.spark.sql("SELECT 'x' AS key, 'NUMBER' AS type, 1L AS n, 0L AS length, 1L AS objects").filter("n = 0"),
    }
    tables["other"] = tables["other"].withColumn("until", F.expr("o_orderdate + make_dt_interval(30, 0, 0, 0)"))
    json = {"payload": "props", "path": "$.k"}
    checks = [
        ("json_enum", "events", (), {**json, "values": [1, 2, 3]}, "event_id"),
        ("json_mapping", "events", (), {**json, "column": "user_id"}, "event_id"),
        ("json_type", "events", (), {**json, "expected": "STRING"}, "event_id"),
        ("late_arrivals", "events", (), {"event_ts": "ts", "arrival_ts": "arrived", "sla_seconds": 300}, "event_id"),
        ("json_unique", "events", (), json, "json_value"),
        ("json_drift", "events", (), {"payload": "props", "baseline": "no_keys"}, "key"),
        ("fact_coverage", "orders", (), {"dimensions": [(["o_custkey"], "rich", ["c_custkey"])]}, "o_orderkey"),
        ("agg_match", "orders", (), {"source": "other", "metrics": {"s": ("sum", "o_custkey")}, "group_by": ["o_orderstatus"]}, "o_orderstatus"),
        ("evidence", "orders", (), {"manifest": Manifest("all", -1)}, "metric"),
        ("schema", "orders", (), {"contract": [("no_such", "NUMBER", None)], "allow_extra": True}, "column"),
        ("drift", "orders", ("o_orderkey",), {"previous": "other"}, "o_orderkey"),
        ("scd2", "orders", ("o_custkey",), {"valid_from": "o_orderdate", "valid_to": "until"}, "o_custkey"),
    ]
    name = {"drift": "row drift"}
    suite = Suite(
        "kinds",
        [Check(name.get(k, k), k, d, keys=keys, params=p) for k, d, keys, p, _ in checks],
    )
    results = S.run_suite(t.spark, suite, tables, AS_OF, "run-1")
    out = S.sample_violations(t.spark, suite, results, tables, as_of=AS_OF, limit=30, strategy="mask")
    first = F.lit(None).cast("string")
    for k, _, _, _, column in checks:
        first = F.when(F.col("_test") == name.get(k, k), F.get_json_object("row", f"$.{column}")).otherwise(first)
    return out.groupBy("_test").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))


# ---------------------------------------------------------------------- history
# Every event stands for one check result: the day is the run, the event type the
# kind of check.

_HIST = """
h AS (SELECT strftime(ts, '%Y-%m-%d') || '/' || (user_id % 5) AS run_id, CASE user_id % 3 WHEN 0 THEN 'Nightly Orders' WHEN 1 THEN 'hourly_orders' ELSE 'events' END AS suite,
             'u' || user_id || '_' || event_type AS test, event_type AS type, CASE WHEN value > 60 THEN 'fail' WHEN event_id % 50 = 0 THEN 'error' WHEN event_id % 33 = 0 THEN 'skip' ELSE 'pass' END AS status,
             CASE event_id % 4 WHEN 0 THEN 'warn' ELSE 'fail' END AS gate, CASE event_id % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'minor' END AS severity,
             value AS observed, ts AS run_at, event_id, CAST(event_id % 1000 AS BIGINT) AS duration_ms FROM events),
runs AS (SELECT run_id, suite AS suite_name, min(run_at) AS started_at, count(*) AS total_tests, count(*) FILTER (status = 'fail') AS failed_tests,
                CAST(sum(duration_ms) AS BIGINT) AS execution_time_ms, CASE WHEN count(*) FILTER (status = 'fail') > 3 THEN 'failed' WHEN count(*) < 8 THEN 'running' ELSE 'completed' END AS status
         FROM h GROUP BY run_id, suite)
"""


def _history(t: Tables) -> DataFrame:
    return t.events.select(
        F.expr("concat(date_format(ts, 'yyyy-MM-dd'), '/', user_id % 5) AS run_id"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'Nightly Orders' WHEN 1 THEN 'hourly_orders' ELSE 'events' END AS suite"),
        F.expr("concat('u', user_id, '_', event_type) AS test"),
        F.col("event_type").alias("type"),
        F.expr(
            "CASE WHEN value > 60 THEN 'fail' WHEN event_id % 50 = 0 THEN 'error' WHEN event_id % 33 = 0 THEN 'skip' ELSE 'pass' END AS status"
        ),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'warn' ELSE 'fail' END AS gate"),
        F.expr("CASE event_id % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'minor' END AS severity"),
        F.col("value").alias("observed"),
        F.col("ts").alias("run_at"),
        F.col("ts").alias("as_of"),
        "event_id",
        F.expr("CAST(event_id % 1000 AS BIGINT) AS duration_ms"),
    )


def _runs(t: Tables) -> DataFrame:
    n, failed = F.count(F.lit(1)), F.count_if(F.col("status") == "fail")
    return (
        _history(t)
        .groupBy("run_id", F.col("suite").alias("suite_name"))
        .agg(
            F.min("run_at").alias("started_at"),
            n.alias("total_tests"),
            failed.alias("failed_tests"),
            F.sum("duration_ms").alias("execution_time_ms"),
            F.when(failed > 3, "failed").when(n < 8, "running").otherwise("completed").alias("status"),
        )
    )


@query(
    "gate_verdict",
    f"""
    WITH {_HIST}, a AS (SELECT run_id, suite, count(*) FILTER (status IN ('fail', 'error') AND gate = 'fail') AS f, count(*) FILTER (status IN ('fail', 'error') AND gate = 'warn') AS w,
         min(CASE WHEN status IN ('fail', 'error') THEN CASE severity WHEN 'blocker' THEN 1 WHEN 'major' THEN 2 ELSE 3 END END) AS s FROM h GROUP BY run_id, suite)
    SELECT run_id, suite, CASE WHEN f > 0 THEN 'fail' WHEN w > 0 THEN 'warn' ELSE 'pass' END AS verdict, f AS failures, w AS warnings,
           CASE s WHEN 1 THEN 'blocker' WHEN 2 THEN 'major' WHEN 3 THEN 'minor' END AS worst FROM a
    """,
)
def gate_verdict(t: Tables) -> DataFrame:
    return S.gate(_history(t))


@query(
    "run_summaries",
    f"""
    WITH {_HIST}, a AS (SELECT run_id, suite AS suite_name, count(*) AS total_tests, count(*) FILTER (status = 'pass') AS passed_tests, count(*) FILTER (status = 'fail') AS failed_tests,
         count(*) FILTER (status = 'error') AS error_tests, count(*) FILTER (status = 'skip') AS skipped_tests, min(run_at) AS started_at, max(run_at) AS ended_at FROM h GROUP BY run_id, suite)
    SELECT *, CASE WHEN total_tests > skipped_tests AND error_tests = total_tests - skipped_tests THEN 'failed' ELSE 'completed' END AS status,
           CAST(floor(date_diff('microsecond', started_at, ended_at) / 1000) AS BIGINT) AS execution_time_ms FROM a
    """,
)
def run_summaries(t: Tables) -> DataFrame:
    return S.run_summary(_history(t)).drop("environment", "connection")


@query(
    "run_list",
    f"""
    WITH {_HIST}, m AS (SELECT * FROM runs WHERE status = 'completed' AND suite_name ILIKE '%orders%' AND started_at >= TIMESTAMP '2024-01-05' AND started_at <= TIMESTAMP '2024-01-25')
    SELECT run_id, suite_name, started_at, total_tests, (SELECT count(*) FROM m) AS total FROM m ORDER BY started_at DESC, run_id LIMIT 20 OFFSET 5
    """,
)
def run_list(t: Tables) -> DataFrame:
    page = H.list_runs(
        _runs(t), "completed", "orders", "2024-01-05 00:00:00", "2024-01-25 00:00:00", 20, 5, with_total=True
    )
    return page.select("run_id", "suite_name", "started_at", "total_tests", "total")


@query(
    "run_page",
    f"WITH {_HIST} SELECT run_id, event_id, test, status FROM h WHERE run_id = '2024-01-10/3' ORDER BY test, event_id LIMIT 30 OFFSET 10",
)
def run_page(t: Tables) -> DataFrame:
    h = _history(t).withColumn("check", F.col("test")).withColumn(
        "test", F.concat("test", F.lit("#"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    )
    page = H.run_results(h, "2024-01-10/3", 30, 10)
    return page.select("run_id", "event_id", F.col("check").alias("test"), "status")


@query(
    "run_stats",
    f"""
    WITH {_HIST}, n AS (SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 100)
    SELECT count(*) AS total_runs, count(*) FILTER (status = 'completed') * 100.0 / count(*) AS success_rate,
           CAST(sum(execution_time_ms) AS DOUBLE) / count(execution_time_ms) AS avg_duration_ms, count(*) FILTER (status = 'running') AS active_runs FROM n
    """.replace("* 100.0 /", "* 100.0::DOUBLE /"),
)
def run_stats(t: Tables) -> DataFrame:
    return H.run_stats(_runs(t))


@query(
    "execution_metrics",
    f"""
    WITH {_HIST}
    SELECT type, status, count(*) AS executions, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, CAST(sum(duration_ms) AS DOUBLE) / count(duration_ms) AS avg_ms FROM h GROUP BY type, status
    """,
)
def execution_metrics(t: Tables) -> DataFrame:
    return H.execution_metrics(_history(t)).drop("p50_ms", "p95_ms")


@query(
    "run_trend",
    f"""
    WITH {_HIST}, d AS (SELECT test, strftime(run_at, '%Y-%m-%d') AS run_id, min(run_at) AS run_at, CAST(sum(CAST(observed AS DECIMAL(18,4))) AS DOUBLE) AS observed FROM h GROUP BY 1, 2)
    SELECT test, run_id, run_at, observed, lag(observed) OVER w AS previous, observed - lag(observed) OVER w AS change FROM d WINDOW w AS (PARTITION BY test ORDER BY run_at, run_id)
    """,
)
def run_trend(t: Tables) -> DataFrame:
    daily = (
        _history(t)
        .groupBy("test", F.date_format("run_at", "yyyy-MM-dd").alias("run_id"))
        .agg(
            F.min("run_at").alias("run_at"),
            F.sum(F.col("observed").cast("decimal(18,4)")).cast("double").alias("observed"),
        )
    )
    return H.trend(daily).drop("change_pct")


@query(
    "history_retained",
    f"WITH {_HIST} SELECT type, count(*) AS n FROM h WHERE run_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY GROUP BY type",
)
def history_retained(t: Tables) -> DataFrame:
    return H.retain(_history(t), 10, AS_OF).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
