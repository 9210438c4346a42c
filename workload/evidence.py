"""Reconciliation with source evidence on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.hashing import checksum
from tablecheck.operators import evidence as E

from .base import Tables, query, status_sql, verdict

_WINDOW = E.EvidenceWindow("ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00")
_TOTALS = ("SUM(value)", "DISTINCT_user_id", "MIN(ts)", "MAX(ts)", "count_if(event_type = 'error')")
_IN = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"


@query(
    "evidence_metrics",
    f"""
    SELECT count(*) AS rowcount, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS sum_value, count(DISTINCT user_id) AS distinct_user_id,
           min(ts) AS min_ts, max(ts) AS max_ts, count(*) FILTER (event_type = 'error') AS errors
    FROM events WHERE {_IN}
    """,
)
def evidence_metrics(t: Tables) -> DataFrame:
    out = E.evidence_metrics(t.events, _WINDOW, _TOTALS)
    return out.withColumn("sum_value", F.col("sum_value").cast("double")).withColumnRenamed(
        E.total_name(_TOTALS[-1]), "errors"
    )


@query(
    "evidence_distincts",
    """
    SELECT event_type, count(*) AS rowcount, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT props) AS distinct_props,
           count(DISTINCT CAST(ts AS DATE)) AS distinct_day, sum(event_id)::BIGINT AS sum_event_id,
           CAST(sum(CAST(value AS DECIMAL(18,4))) + 1000000000000000 * count(*) AS DOUBLE) AS sum_far
    FROM events GROUP BY event_type
    """,
)
def evidence_distincts(t: Tables) -> DataFrame:
    """Several DISTINCT totals per group, and a float total of 1e15 a row."""
    e = t.events.withColumns({"day": F.to_date("ts"), "far": F.lit(1e15)})
    totals = ("DISTINCT(user_id)", "DISTINCT(props)", "DISTINCT_day", "SUM(event_id)", "SUM(far)", "SUM(value)")
    out = E.evidence_metrics(e, None, totals, by=["event_type"])
    return out.withColumn("sum_far", F.col("sum_far") + F.col("sum_value")).drop("sum_value")


# The evidence is a fixed statement by the source; the table decides the answer.
_MANIFEST = E.Manifest(
    "2024-01",
    5000,
    {
        "SUM(value)": 50000.0,
        "DISTINCT(user_id)": 100,
        "MIN(ts)": "2024-01-05 00:00:00",
        "MAX_event_id": 6332,
        "count_if(event_type = 'none')": 0,
        "SUM(event_id)": None,
    },
)


@query(
    "evidence_reconcile",
    f"""
    WITH m AS (SELECT count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS s, count(DISTINCT user_id) AS u,
                      min(ts) AS lo, max(event_id) AS hi FROM events WHERE {_IN}),
         r AS (SELECT 'rowcount' AS metric, abs(n - 5000.0) AS abs_diff, abs(n - 5000.0) / 5000 * 100 AS pct_diff,
                      abs(n - 5000.0) <= 50 OR abs(n - 5000.0) / 5000 * 100 <= 1 AS within FROM m
               UNION ALL SELECT 'sum_value', abs(s - 50000), abs(s - 50000) / 50000 * 100, abs(s - 50000) / 50000 * 100 <= 20 FROM m
               UNION ALL SELECT 'distinct_user_id', abs(u - 100.0), abs(u - 100.0) / 100 * 100, abs(u - 100.0) / 100 * 100 <= 20 FROM m
               UNION ALL SELECT 'min_ts', NULL, NULL, lo = TIMESTAMP '2024-01-05 00:00:00' FROM m
               UNION ALL SELECT 'max_event_id', abs(hi - 6332.0), abs(hi - 6332.0) / 6332 * 100, abs(hi - 6332.0) / 6332 * 100 <= 20 FROM m
               UNION ALL SELECT 'count_if_event_type_none', 0, NULL, true
               UNION ALL SELECT 'sum_event_id', NULL, NULL, false)
    SELECT metric, CAST(round(abs_diff, 4) AS DOUBLE) AS abs_diff, CAST(round(pct_diff, 6) AS DOUBLE) AS pct_diff, within FROM r
    """,
)
def evidence_reconcile(t: Tables) -> DataFrame:
    out = E.reconcile_evidence(
        t.events, _WINDOW, _MANIFEST, E.EvidenceTolerance(50, 1.0, 20.0)
    )
    return out.select(
        "metric",
        F.round("abs_diff", 4).alias("abs_diff"),
        F.round("pct_diff", 6).alias("pct_diff"),
        "within",
    )


@query(
    "evidence_batches",
    """
    WITH e AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS batch FROM events),
         a AS (SELECT CASE WHEN batch = '2024-01-03' THEN 'unknown' ELSE batch END AS batch, count(*) AS rowcount, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS s, count(DISTINCT user_id) AS u FROM e GROUP BY 1),
         m AS (SELECT CASE WHEN batch = '2024-01-04' THEN 'lost' ELSE batch END AS batch, count(*) + CASE WHEN max(event_id) % 3 = 0 THEN 1 ELSE 0 END AS rowcount,
                      CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) * CASE WHEN max(event_id) % 2 = 0 THEN 1.02 ELSE 1.001 END AS s,
                      count(DISTINCT user_id) AS u FROM e GROUP BY 1),
         j AS (SELECT coalesce(a.batch, m.batch) AS batch_id, a.rowcount AS ar, m.rowcount AS mr, a.s AS sa, m.s AS sm, a.u AS au, m.u AS mu FROM a FULL JOIN m USING (batch))
    SELECT batch_id, 'rowcount' AS metric, coalesce(ar = mr, false) AS within FROM j
    UNION ALL SELECT batch_id, 'sum_value', coalesce(abs(sa - sm) / abs(sm) * 100 <= 0.5, false) FROM j
    UNION ALL SELECT batch_id, 'distinct_user_id', coalesce(au = mu, false) FROM j
    """,
)
def evidence_batches(t: Tables) -> DataFrame:
    e = t.events.withColumn("batch", F.to_date("ts").cast("string"))
    manifests = (
        e.groupBy(F.expr("IF(batch = '2024-01-04', 'lost', batch) AS batch_id"))
        .agg(
            (F.count(F.lit(1)) + F.when(F.max("event_id") % 3 == 0, 1).otherwise(0)).alias("rowcount"),
            (
                F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
                * F.when(F.max("event_id") % 2 == 0, 1.02).otherwise(1.001)
            ).alias("sum_value"),
            F.count_distinct("user_id").alias("distinct_user_id"),
        )
    )
    out = E.reconcile_batches(
        e.withColumn("batch", F.expr("IF(batch = '2024-01-03', 'unknown', batch)")), "batch", manifests, ["SUM(value)", "DISTINCT(user_id)"]
    )
    return out.select("batch_id", "metric", "within")


@query(
    "evidence_keys",
    f"""
    WITH s AS (SELECT sha256(CAST(o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000000 ELSE 0 END AS VARCHAR)) AS k FROM orders),
         a AS (SELECT count(DISTINCT k) AS n FROM s WHERE k NOT IN (SELECT sha256(CAST(CASE WHEN o_orderpriority = '5-LOW' THEN -o_orderkey ELSE o_orderkey END AS VARCHAR)) FROM orders))
    SELECT {status_sql("n > 0")}, n AS violations, n AS missing_keys FROM a
    """,
)
def evidence_keys(t: Tables) -> DataFrame:
    sample = t.orders.select(
        F.expr(
            "sha2(CAST(o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000000 ELSE 0 END AS STRING), 256) AS key"
        )
    )
    table = t.orders.withColumn("o_orderkey", F.expr("IF(o_orderpriority = '5-LOW', -o_orderkey, o_orderkey)"))
    return verdict(E.check_evidence_keys(table, "o_orderkey", sample, masked=True), missing_keys="bigint")


_ROW_TEXT = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(length({c}::VARCHAR), ':', {c}::VARCHAR) END"
    for c in ("event_id", "user_id", "event_type", "props")
) + ")"


@query(
    "evidence_checksum",
    f"""
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, count(*) AS n,
           CAST(sum(CAST(CAST('0x' || substr(md5({_ROW_TEXT}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS checksum
    FROM events GROUP BY 1
    """,
)
def evidence_checksum(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").cast("string").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"),
        checksum(["event_id", "user_id", "event_type", "props"]).alias("checksum"),
    )


@query(
    "evidence_checksum_check",
    f"""
    WITH a AS (SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(md5({_ROW_TEXT}), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS c
               FROM events WHERE {_IN})
    SELECT CASE WHEN c = '0' THEN 'pass' ELSE 'fail' END AS status, CAST(CASE WHEN c = '0' THEN 0 ELSE 1 END AS BIGINT) AS violations, n AS row_count, c AS checksum FROM a
    """,
)
def evidence_checksum_check(t: Tables) -> DataFrame:
    """The stated checksum is wrong; the one that was found decides and is compared."""
    r = E.check_evidence_checksum(t.events, _WINDOW, ["event_id", "user_id", "event_type", "props"], "0")
    return verdict(r, row_count="bigint", checksum="string")


@query(
    "evidence_contract",
    """
    WITH a AS (SELECT count(*) AS n, count(*) FILTER (NOT json_exists(props, '$.k')) AS m1, count(*) FILTER (NOT json_exists(props, '$.z')) AS m2,
                      count(*) FILTER (json_type(props, '$.k') NOT IN ('VARCHAR')) AS t1, count(*) FILTER (event_type IS NULL) AS k1 FROM events)
    SELECT CASE WHEN 2 + m1 + m2 + t1 + k1 > 0 THEN 'fail' ELSE 'pass' END AS status, 2 + m1 + m2 + t1 + k1 AS violations, n AS total_rows,
           CAST(2 AS BIGINT) AS schema, m2 AS missing_z, t1 AS mistyped_k FROM a
    """,
)
def evidence_contract(t: Tables) -> DataFrame:
    r = E.check_evidence_contract(
        t.events,
        fields=[("event_id", "NUMBER", None), ("ts", "TIMESTAMP", None), ("value", "STRING", None), ("batch", "STRING", None)],
        payload="props",
        paths={"$.k": "STRING", "$.z": "NUMBER"},
        keys=["event_type"],
    )
    return verdict(
        r,
        total_rows="bigint",
        schema="bigint",
        named={"missing_z": ("missing_1", "bigint"), "mistyped_k": ("mistyped_0", "bigint")},
    )
