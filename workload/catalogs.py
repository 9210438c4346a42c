"""Catalogs observed in data, diffs, lineage, proposals, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.payloads import is_valid_json
from tablecheck.operators.contracts import schema_measurement, schema_drift_measurement
from tablecheck.plans import budget, catalog as K, lineage, proposals
from tablecheck.verdict import result

from .base import Tables, query, status_sql, verdict
from .payloads import _E, _events

_CUT = "2024-01-16 00:00:00"


def _observed_sql(name: str, dataset: str, cond: str) -> str:
    return f"""
    {name}_k AS (SELECT {dataset} AS dataset, unnest(json_keys(j)) AS "column", j FROM e WHERE {cond}),
    {name}_t AS (SELECT dataset, "column", CASE json_type(j, '$.' || "column") WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'NUMBER'
                 WHEN 'BIGINT' THEN 'NUMBER' WHEN 'DOUBLE' THEN 'NUMBER' ELSE json_type(j, '$.' || "column") END AS ty FROM {name}_k),
    {name}_n AS (SELECT {dataset} AS dataset, count(*) AS total FROM e WHERE {cond} GROUP BY 1),
    {name} AS (SELECT dataset, "column", CASE WHEN count(DISTINCT ty) FILTER (ty <> 'NULL') > 1 THEN 'VARIANT' ELSE max(ty) FILTER (ty <> 'NULL') END AS type,
               count(*) FILTER (ty <> 'NULL') < any_value(total) AS nullable FROM {name}_t JOIN {name}_n USING (dataset) GROUP BY dataset, "column")"""


def _observed(t: Tables, cond: str = "true", dataset: str = "event_type") -> DataFrame:
    e = _events(t).filter(cond).withColumn("ds", F.expr(dataset))
    return K.observed_columns(e, "ds", "payload")


@query(
    "catalog_observed",
    f'WITH {_E}, {_observed_sql("c", "event_type", "true")} SELECT dataset, "column", type, nullable FROM c',
)
def catalog_observed(t: Tables) -> DataFrame:
    return _observed(t).drop("description")


@query(
    "catalog_signature",
    f"""
    WITH {_E}, {_observed_sql("c", "event_type", "true")}
    SELECT dataset, sha256(string_agg("column" || ':' || type || ':' || CASE WHEN nullable THEN 'True' ELSE 'False' END, '|' ORDER BY "column")) AS signature
    FROM c GROUP BY dataset
    """,
)
def catalog_signature(t: Tables) -> DataFrame:
    return K.dataset_signatures(_observed(t))


_NOW = f"ts >= timestamp_ntz'{_CUT}' AND event_type <> 'view'"
_BEFORE = f"ts < timestamp_ntz'{_CUT}' AND event_type <> 'click'"
_NOW_SQL = _NOW.replace("timestamp_ntz'", "TIMESTAMP '")
_BEFORE_SQL = _BEFORE.replace("timestamp_ntz'", "TIMESTAMP '")

_DIFF_SQL = f"""
WITH {_E}, {_observed_sql("c", "event_type", _NOW_SQL)}, {_observed_sql("p", "event_type", _BEFORE_SQL)},
     j AS (SELECT coalesce(c.dataset, p.dataset) AS dataset, coalesce(c."column", p."column") AS col, c.dataset IS NOT NULL AS ic, p.dataset IS NOT NULL AS ip,
                  p.type AS ft, c.type AS tt, p.nullable AS fn, c.nullable AS tn FROM c FULL JOIN p ON c.dataset = p.dataset AND c."column" = p."column"),
     s AS (SELECT dataset, bool_or(ic) AS now, bool_or(ip) AS before, bool_or(NOT (ic AND ip) OR ft <> tt OR fn <> tn) AS differs FROM j GROUP BY dataset),
     d AS (SELECT dataset, CASE WHEN NOT before THEN 'dataset_added' WHEN NOT now THEN 'dataset_removed' WHEN differs THEN 'dataset_modified' END AS change,
                  NULL::VARCHAR AS col, NULL::VARCHAR AS ft, NULL::VARCHAR AS tt FROM s
           UNION ALL SELECT j.dataset, 'column_added', col, NULL, tt FROM j JOIN s USING (dataset) WHERE now AND before AND NOT ip
           UNION ALL SELECT j.dataset, 'column_removed', col, ft, NULL FROM j JOIN s USING (dataset) WHERE now AND before AND NOT ic
           UNION ALL SELECT j.dataset, 'type_changed', col, ft, tt FROM j JOIN s USING (dataset) WHERE now AND before AND ic AND ip AND ft <> tt
           UNION ALL SELECT j.dataset, 'nullable_changed', col, fn::VARCHAR, tn::VARCHAR FROM j JOIN s USING (dataset) WHERE now AND before AND ic AND ip AND fn <> tn)
"""


@query(
    "catalog_diff",
    _DIFF_SQL
    + """SELECT dataset, change, col AS "column", ft AS from_type, tt AS to_type FROM d WHERE change IS NOT NULL""",
)
def catalog_diff(t: Tables) -> DataFrame:
    return K.catalog_diff(_observed(t, _NOW), _observed(t, _BEFORE))


@query(
    "schema_drift",
    _DIFF_SQL
    + f""", a AS (SELECT count(*) FILTER (change <> 'dataset_modified') AS n, count(*) FILTER (change = 'column_added') AS added,
                        count(*) FILTER (change = 'type_changed') AS types, count(*) FILTER (change = 'nullable_changed') AS nulls FROM d WHERE change IS NOT NULL)
    SELECT {status_sql("n > 0")}, n AS violations, added AS column_added, types AS type_changed, nulls AS nullable_changed FROM a""",
)
def schema_drift(t: Tables) -> DataFrame:
    r = result("drift", schema_drift_measurement(_observed(t, _NOW), _observed(t, _BEFORE)))
    return verdict(r, column_added="bigint", type_changed="bigint", nullable_changed="bigint")


@query(
    "schema_contract",
    f"""
    WITH {_E}, {_observed_sql("c", "'events'", "j IS NOT NULL")},
         w AS (SELECT * FROM (VALUES ('id', 'NUMBER', false), ('amount', 'NUMBER', true), ('status', 'STRING', true), ('event_ts', 'STRING', NULL), ('batch', 'STRING', false)) v(col, ty, nu)),
         j AS (SELECT c."column" AS cc, w.col AS wc, c.type AS ct, w.ty AS wt, c.nullable AS cn, w.nu AS wn FROM c FULL JOIN w ON c."column" = w.col),
         a AS (SELECT count(*) FILTER (cc IS NULL) AS missing, count(*) FILTER (wc IS NULL) AS extra, count(*) FILTER (ct <> wt) AS ty, count(*) FILTER (cn <> wn) AS nu FROM j)
    SELECT {status_sql("missing + extra + ty + nu > 0")}, missing + extra + ty + nu AS violations, missing, extra, ty AS type, nu AS nullable FROM a
    """,
)
def schema_contract(t: Tables) -> DataFrame:
    observed = _readable(t)
    contract = K.contract_frame(
        t.spark,
        [
            ("id", "NUMBER", False),
            ("amount", "NUMBER", True),
            ("status", "STRING", True),
            ("event_ts", "STRING", None),
            ("batch", "STRING", False),
        ],
    )
    r = result("schema", schema_measurement(observed.drop("dataset"), contract))
    return verdict(r, missing="bigint", extra="bigint", type="bigint", nullable="bigint")


def _readable(t: Tables) -> DataFrame:
    """Columns of the readable payloads, as one dataset."""
    e = _events(t).filter(is_valid_json(F.col("payload")))
    return K.observed_columns(e, None, "payload", "events")


# --------------------------------------------------------------------- lineage

_EDGES_SQL = """
edges AS (SELECT DISTINCT 'C' || c_nationkey AS upstream, 'O' || o_custkey AS downstream FROM orders JOIN customer ON o_custkey = c_custkey
          UNION SELECT DISTINCT 'O' || o_custkey, 'S' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          UNION SELECT DISTINCT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
          UNION SELECT DISTINCT 'N' || n_nationkey, 'C' || n_nationkey FROM nation)
"""


def _edges(t: Tables) -> DataFrame:
    def pair(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.expr(a).alias("upstream"), F.expr(b).alias("downstream"))

    customer, orders = t.customer, t.orders
    return (
        pair(
            orders.join(customer, F.col("o_custkey") == F.col("c_custkey")),
            "concat('C', c_nationkey)",
            "concat('O', o_custkey)",
        )
        .unionByName(
            pair(
                t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")),
                "concat('O', o_custkey)",
                "concat('S', l_suppkey)",
            )
        )
        .unionByName(pair(t.supplier, "concat('S', s_suppkey)", "concat('N', s_nationkey)"))
        .unionByName(
            pair(t.nation, "concat('N', n_nationkey)", "concat('C', n_nationkey)")
        )
    )


_CLOSURE_SQL = f"""
WITH RECURSIVE {_EDGES_SQL},
     start AS (SELECT DISTINCT 'O' || c_custkey AS dataset FROM customer WHERE c_acctbal < 0),
     r(dataset) AS (SELECT dataset FROM start UNION SELECT downstream FROM r JOIN edges ON upstream = dataset)
"""


@query("impact_closure", _CLOSURE_SQL + "SELECT dataset FROM r")
def impact_closure(t: Tables) -> DataFrame:
    changed = t.customer.filter("c_acctbal < 0").select(F.expr("concat('O', c_custkey) AS dataset"))
    return lineage.downstream(_edges(t), changed).select("dataset")


@query(
    "select_impacted",
    _CLOSURE_SQL
    + "SELECT 'check_' || s_name AS test, 'S' || s_suppkey AS dataset FROM supplier WHERE 'S' || s_suppkey IN (SELECT dataset FROM r)",
)
def select_impacted(t: Tables) -> DataFrame:
    changed = t.customer.filter("c_acctbal < 0").select(F.expr("concat('O', c_custkey) AS dataset"))
    suite = t.supplier.select(
        F.expr("concat('check_', s_name) AS test"), F.expr("concat('S', s_suppkey) AS dataset")
    )
    return lineage.select_impacted(suite, changed, _edges(t)).select("test", "dataset")


# ------------------------------------------------------- proposals and budgets

_DATASETS_SQL = """
d AS (SELECT CASE o_custkey % 6 WHEN 0 THEN 'RAW.ORDERS_' WHEN 1 THEN 'PREP.ORDERS_' WHEN 2 THEN 'stage.items_' WHEN 3 THEN 'DIM.CUST_' WHEN 4 THEN 'FACT.SALES_' ELSE 'SRC.X_' END || o_custkey AS dataset,
             count(*) AS n, o_custkey AS k FROM orders GROUP BY o_custkey)
"""


def _datasets(t: Tables) -> DataFrame:
    name = (
        "concat(CASE o_custkey % 6 WHEN 0 THEN 'RAW.ORDERS_' WHEN 1 THEN 'PREP.ORDERS_' WHEN 2 THEN 'stage.items_' "
        "WHEN 3 THEN 'DIM.CUST_' WHEN 4 THEN 'FACT.SALES_' ELSE 'SRC.X_' END, o_custkey) AS dataset"
    )
    fk = F.expr(
        "array(named_struct('columns', array('customer_id'), 'ref_table', 'DIM.CUSTOMER', 'ref_columns', array('customer_id'))) AS foreign_keys"
    )
    return (
        t.orders.groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("row_count_estimate"))
        .select(
            F.expr(name),
            F.lit("table").alias("kind"),
            "row_count_estimate",
            F.expr("CASE WHEN o_custkey % 12 = 0 THEN array('order_id') ELSE array() END AS primary_key"),
            fk,
            F.lit(None).cast("string").alias("watermark_column"),
            F.array().cast("array<string>").alias("lineage"),
            "o_custkey",
        )
    )


_RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', '{}', '{}', '{}', {}, {}, '{}')".format(
        r[0], r[1], r[2], r[3], r[4], r[5], str("deep" in r[7].split(",")).lower(), r[8]
    )
    for r in proposals.RULES
    if "deep" in r[6].split(",")
) + ") v(layer, prefix, type, severity, gate, confidence, auto, needs))"


@query(
    "proposals",
    f"""
    WITH {_DATASETS_SQL}, {_RULES_SQL},
         l AS (SELECT *, CASE WHEN upper(dataset) LIKE 'RAW.%' THEN 'RAW' WHEN upper(dataset) LIKE 'PREP.%' OR upper(dataset) LIKE 'STAGE.%' THEN 'PREP'
                              WHEN upper(dataset) LIKE 'MART.%' OR upper(dataset) LIKE 'DIM.%' OR upper(dataset) LIKE 'FACT.%' THEN 'MART' ELSE 'UNKNOWN' END AS layer,
                         CASE WHEN k % 12 = 0 THEN 'order_id' ELSE 'id_' || (k % 25) END AS pk FROM d)
    SELECT prefix || '_' || replace(lower(dataset), '.', '_') AS test, type, dataset, layer,
           CASE WHEN type IN ('uniqueness', 'not_null') THEN pk ELSE '' END AS keys,
           CASE needs WHEN 'order' THEN 'order_total == items_total + tax + shipping' WHEN 'reference' THEN 'customer_id references DIM.CUSTOMER' END AS expression,
           severity, gate, CAST(confidence AS DOUBLE) AS confidence, auto AS auto_approvable
    FROM l JOIN rules USING (layer)
    WHERE CASE needs WHEN 'order' THEN upper(dataset) LIKE '%ORDER%' WHEN 'dimension' THEN upper(dataset) LIKE '%DIM.%' WHEN 'fact' THEN upper(dataset) LIKE '%FACT.%' ELSE true END
    """,
)
def propose(t: Tables) -> DataFrame:
    d = _datasets(t)
    keys = d.select("dataset", F.expr("concat('id_', o_custkey % 25) AS column"))
    out = proposals.propose_tests(d.drop("o_custkey"), keys, "deep")
    return out.select(
        "test",
        "type",
        "dataset",
        "layer",
        F.coalesce(F.concat_ws(",", "keys"), F.lit("")).alias("keys"),
        "expression",
        "severity",
        "gate",
        "confidence",
        "auto_approvable",
    )


@query(
    "dataset_layers",
    f"""
    WITH {_DATASETS_SQL}
    SELECT dataset, CASE WHEN upper(dataset) LIKE 'RAW.%' THEN 'RAW' WHEN upper(dataset) LIKE 'PREP.%' OR upper(dataset) LIKE 'STAGE.%' THEN 'PREP'
           WHEN upper(dataset) LIKE 'MART.%' OR upper(dataset) LIKE 'DIM.%' OR upper(dataset) LIKE 'FACT.%' THEN 'MART' ELSE 'UNKNOWN' END AS layer FROM d
    """,
)
def dataset_layers(t: Tables) -> DataFrame:
    return _datasets(t).select("dataset", proposals.detect_layer(F.col("dataset")).alias("layer"))


@query(
    "dataset_page",
    f"WITH {_DATASETS_SQL} SELECT dataset, n AS row_count_estimate FROM d WHERE lower(dataset) LIKE '%orders%' ORDER BY dataset LIMIT 25 OFFSET 10",
)
def dataset_page(t: Tables) -> DataFrame:
    page = K.list_datasets(_datasets(t), "orders", "table", 25, 10)
    return page.select("dataset", "row_count_estimate")


@query(
    "tolerance_history",
    """
    WITH h AS (SELECT event_type || '_' || (user_id % 10) AS test, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL),
         m AS (SELECT test, median(n) AS center, count(*) AS runs FROM h GROUP BY test),
         v AS (SELECT test, any_value(center) AS center, any_value(runs) AS runs, median(abs(n - center)) AS deviation FROM h JOIN m USING (test) GROUP BY test)
    SELECT test, center, deviation, runs, greatest(0.01, 3.0 * deviation) AS tolerance FROM v
    """,
)
def tolerance_history(t: Tables) -> DataFrame:
    history = t.events.groupBy(
        F.expr("concat(event_type, '_', user_id % 10) AS test"), F.to_date("ts").alias("run")
    ).agg(F.count(F.lit(1)).alias("observed"))
    return proposals.propose_tolerance(history)


@query(
    "budget_plan",
    """
    WITH p AS (SELECT 'u' || user_id AS test, CASE user_id % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'minor' END AS severity,
                      CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank, CAST(sum(length(props)) AS BIGINT) AS b FROM events GROUP BY user_id),
         w AS (SELECT *, CAST(sum(b) OVER (ORDER BY rank, b, test ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM p)
    SELECT test, severity, b AS scan_bytes, used AS used_bytes, used <= 60000 AS keep,
           CAST(CASE WHEN used <= 60000 THEN 1.0 ELSE greatest(0.0, (60000 - (used - b)) / greatest(b, 1)) END AS DOUBLE) AS sample_fraction FROM w
    """,
)
def budget_plan(t: Tables) -> DataFrame:
    plan = t.events.groupBy("user_id").agg(F.sum(F.length("props")).alias("scan_bytes")).select(
        F.expr("concat('u', user_id) AS test"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'major' ELSE 'minor' END AS severity"),
        "scan_bytes",
        F.lit(None).cast("double").alias("seconds"),
    )
    out = budget.check_budget(plan, scan_bytes=60000)
    return out.select("test", "severity", "scan_bytes", "used_bytes", "keep", "sample_fraction")
