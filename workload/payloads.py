"""JSON payload checks on a payload column built from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.predicates import Filter
from tablecheck.operators import payload as J
from tablecheck.operators.transform import TxSpec, apply_txspec

from .base import AS_OF, Tables, query, status_sql, verdict

# The same expression runs in both engines; only the time format differs.
_PAYLOAD = """
CASE WHEN event_id % 40 = 0 THEN NULL
     WHEN event_id % 41 = 0 THEN '{"id": 1'
     WHEN event_id % 43 = 0 THEN '{"id":' || CAST(event_id AS STRING) || '} x'
     ELSE '{"id":' || CAST(CASE WHEN event_id % 29 = 0 THEN event_id - 1 ELSE event_id END AS STRING)
          || CASE WHEN event_id % 7 = 0 THEN ',"amount":"n/a"'
                  WHEN event_id % 7 = 1 THEN ',"amount":null'
                  WHEN event_id % 7 = 2 THEN ''
                  ELSE ',"amount":' || CAST(CAST(value AS DECIMAL(12,2)) AS STRING) END
          || ',"status":"' || event_type || '"'
          || ',"event_ts":"' || CASE WHEN event_id % 31 = 0 THEN 'yesterday' ELSE {ts} END || '"'
          || ',"schema_version":"v' || CAST(event_id % 4 AS STRING) || '"'
          || ',"user":{"uid":' || CAST(CASE WHEN event_id % 23 = 0 THEN user_id + 1 ELSE user_id END AS STRING) || '}'
          || CASE WHEN event_id % 4 = 0 THEN ',"items":[]'
                  WHEN event_id % 4 = 1 THEN ',"items":[{"pid":' || CAST(user_id AS STRING) || '}]'
                  WHEN event_id % 4 = 2 THEN ',"items":[{"pid":' || CAST(user_id AS STRING) || '},{"pid":' || CAST(user_id + 1 AS STRING) || '}]'
                  ELSE '' END
          || CASE WHEN {late} AND event_id % 3 = 0 THEN ',"extra":true' ELSE '' END
          || '}' END
"""
_SPARK = _PAYLOAD.replace("{ts}", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')").replace(
    "{late}", "ts >= timestamp_ntz'2024-01-16 00:00:00'"
)
_DUCK = _PAYLOAD.replace("{ts}", "strftime(ts, '%Y-%m-%d %H:%M:%S')").replace(
    "{late}", "ts >= TIMESTAMP '2024-01-16 00:00:00'"
)
_E = f"""e0 AS (SELECT *, {_DUCK} AS payload FROM events),
e AS (SELECT *, CASE WHEN json_valid(payload) THEN payload END AS j FROM e0)"""


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("payload", F.expr(_SPARK))


@query(
    "json_valid",
    f"""
    WITH {_E}, a AS (SELECT count(payload) AS n, count(j) AS ok FROM e)
    SELECT {status_sql("ok < n")}, n - ok AS violations, n AS total_rows, ok AS valid_json_count, n - ok AS invalid_json_count FROM a
    """,
)
def json_valid(t: Tables) -> DataFrame:
    r = J.check_json_valid(_events(t), "payload")
    return verdict(r, total_rows="bigint", valid_json_count="bigint", invalid_json_count="bigint")


@query(
    "json_valid_props",
    f"""
    WITH a AS (SELECT count(props) AS n, count(*) FILTER (json_valid(props)) AS ok FROM events)
    SELECT {status_sql("ok < n")}, n - ok AS violations, n AS total_rows, ok AS valid_json_count FROM a
    """,
)
def json_valid_props(t: Tables) -> DataFrame:
    return verdict(J.check_json_valid(t.events, "props"), total_rows="bigint", valid_json_count="bigint")


@query(
    "json_path",
    f"""
    WITH {_E}, a AS (SELECT count(payload) AS n, count(*) FILTER (coalesce(json_exists(j, '$.amount'), false)) AS ok FROM e)
    SELECT {status_sql("ok < n")}, n - ok AS violations, n AS total_rows, ok AS path_exists_count, n - ok AS missing_path_count FROM a
    """,
)
def json_path(t: Tables) -> DataFrame:
    r = J.check_json_path(_events(t), "payload", "$.amount")
    return verdict(r, total_rows="bigint", path_exists_count="bigint", missing_path_count="bigint")


@query(
    "json_path_nested",
    f"""
    WITH {_E}, a AS (SELECT count(payload) AS n, count(*) FILTER (coalesce(json_exists(j, '$.user.uid'), false)) AS ok FROM e)
    SELECT {status_sql("ok < n")}, n - ok AS violations, ok AS path_exists_count FROM a
    """,
)
def json_path_nested(t: Tables) -> DataFrame:
    return verdict(J.check_json_path(_events(t), "payload", "$.user.uid"), path_exists_count="bigint")


_CLASS = """CASE json_type(j, '{path}') WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'BIGINT' THEN 'NUMBER'
 WHEN 'DOUBLE' THEN 'NUMBER' WHEN 'DECIMAL' THEN 'NUMBER' WHEN 'HUGEINT' THEN 'NUMBER' ELSE json_type(j, '{path}') END"""


@query(
    "json_type",
    f"""
    WITH {_E}, c AS (SELECT {_CLASS.format(path="$.amount")} AS cls FROM e),
         a AS (SELECT count(cls) AS n, count(*) FILTER (cls = 'NUMBER') AS ok FROM c)
    SELECT {status_sql("ok < n")}, n - ok AS violations, n AS total_rows, ok AS correct_type_count, n - ok AS wrong_type_count FROM a
    """,
)
def json_type(t: Tables) -> DataFrame:
    r = J.check_json_type(_events(t), "payload", "$.amount", "NUMBER")
    return verdict(r, total_rows="bigint", correct_type_count="bigint", wrong_type_count="bigint")


@query(
    "json_type_classes",
    f"""
    WITH {_E}, u AS (
      SELECT 'id' AS k, {_CLASS.format(path="$.id")} AS cls FROM e UNION ALL
      SELECT 'amount', {_CLASS.format(path="$.amount")} FROM e UNION ALL
      SELECT 'status', {_CLASS.format(path="$.status")} FROM e UNION ALL
      SELECT 'user', {_CLASS.format(path="$.user")} FROM e UNION ALL
      SELECT 'items', {_CLASS.format(path="$.items")} FROM e UNION ALL
      SELECT 'extra', {_CLASS.format(path="$.extra")} FROM e)
    SELECT k, cls, count(*) AS n FROM u WHERE cls IS NOT NULL GROUP BY k, cls
    """,
)
def json_type_classes(t: Tables) -> DataFrame:
    from tablecheck.functions.payloads import at, type_class

    v = J.with_parsed(_events(t).select("payload"), "payload").select(F.col("_v_payload").alias("v"))
    names = ("id", "amount", "status", "user", "items", "extra")
    pairs = F.array(
        *[F.struct(F.lit(k).alias("k"), type_class(at(F.col("v"), f"$.{k}")).alias("cls")) for k in names]
    )
    long = v.select(F.inline(pairs)).filter(F.col("cls").isNotNull())
    return long.groupBy("k", "cls").agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_unique",
    f"""
    WITH {_E}, g AS (SELECT json_extract_string(j, '$.id') AS id, count(*) AS n FROM e WHERE json_exists(j, '$.id') GROUP BY 1),
         a AS (SELECT count(*) FILTER (n > 1) AS k, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS d, CAST(sum(n) AS BIGINT) AS total FROM g)
    SELECT {status_sql("k > 0")}, k AS violations, k AS duplicate_groups, d AS total_duplicates, total AS total_rows FROM a
    """,
)
def json_unique(t: Tables) -> DataFrame:
    r = J.check_json_unique(_events(t), "payload", "$.id")
    return verdict(r, duplicate_groups="bigint", total_duplicates="bigint", total_rows="bigint")


@query(
    "json_unique_props",
    f"""
    WITH g AS (SELECT json_extract_string(props, '$.k') AS id, count(*) AS n FROM events GROUP BY 1),
         a AS (SELECT count(*) FILTER (n > 1) AS k, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS d FROM g)
    SELECT {status_sql("k > 0")}, k AS violations, d AS total_duplicates FROM a
    """,
)
def json_unique_props(t: Tables) -> DataFrame:
    return verdict(J.check_json_unique(t.events, "props", "$.k"), total_duplicates="bigint")


@query(
    "json_enum",
    f"""
    WITH {_E}, s AS (SELECT json_extract_string(j, '$.status') AS v FROM e),
         a AS (SELECT count(v) AS n, count(*) FILTER (v NOT IN ('click', 'view')) AS bad FROM s)
    SELECT {status_sql("bad > 0")}, bad AS violations, n AS total_rows FROM a
    """,
)
def json_enum(t: Tables) -> DataFrame:
    r = J.check_json_enum(_events(t), "payload", "$.status", ["click", "view"])
    return verdict(r, total_rows="bigint")


@query(
    "json_version",
    f"""
    WITH {_E}, s AS (SELECT json_extract_string(j, '$.schema_version') AS v FROM e),
         a AS (SELECT count(*) FILTER (v NOT IN ('v1', 'v2', 'v3')) AS bad FROM s)
    SELECT {status_sql("bad > 0")}, bad AS violations, 'warn' AS gate FROM a
    """,
)
def json_version(t: Tables) -> DataFrame:
    r = J.check_json_version(_events(t), "payload", "$.schema_version", ["v1", "v2", "v3"], "warn")
    return verdict(r, "gate")


@query(
    "json_mapping",
    f"""
    WITH {_E}, s AS (SELECT payload, user_id, TRY_CAST(json_extract_string(j, '$.user.uid') AS BIGINT) AS u, json_exists(j, '$.user.uid') AS there FROM e),
         a AS (SELECT count(payload) AS n, count(*) FILTER (payload IS NOT NULL AND there AND u = user_id) AS eq,
                      count(*) FILTER (payload IS NOT NULL AND there AND u <> user_id) AS ne,
                      count(*) FILTER (payload IS NOT NULL AND NOT coalesce(there, false)) AS missing FROM s)
    SELECT {status_sql("ne > 0")}, ne AS violations, n AS total_rows, eq AS matching_rows, ne AS mismatched_rows, missing AS missing_path FROM a
    """,
)
def json_mapping(t: Tables) -> DataFrame:
    r = J.check_json_mapping(_events(t), "payload", "$.user.uid", "user_id")
    return verdict(
        r, total_rows="bigint", matching_rows="bigint", mismatched_rows="bigint", missing_path="bigint"
    )


@query(
    "json_timestamp",
    f"""
    WITH {_E}, s AS (SELECT json_extract_string(j, '$.event_ts') AS v FROM e),
         a AS (SELECT count(v) AS n, count(*) FILTER (v IS NOT NULL AND TRY_CAST(v AS TIMESTAMP) IS NULL) AS bad FROM s)
    SELECT {status_sql("bad > 0")}, bad AS violations, n AS total_rows FROM a
    """,
)
def json_timestamp(t: Tables) -> DataFrame:
    return verdict(J.check_json_timestamp(_events(t), "payload", "$.event_ts"), total_rows="bigint")


@query(
    "json_fresh",
    f"""
    WITH {_E}, m AS (SELECT max(TRY_CAST(json_extract_string(j, '$.event_ts') AS TIMESTAMP)) AS newest FROM e),
         l AS (SELECT newest, date_diff('hour', newest, TIMESTAMP '2024-01-31 00:00:00') AS lag FROM m)
    SELECT {status_sql("lag > 24")}, CAST(greatest(0, lag - 24) AS BIGINT) AS violations, CAST(lag AS DOUBLE) AS observed, newest AS max_timestamp FROM l
    """,
)
def json_fresh(t: Tables) -> DataFrame:
    r = J.check_json_fresh(_events(t), "payload", "$.event_ts", 24, AS_OF)
    return verdict(r, "observed", max_timestamp="timestamp_ntz")


@query(
    "json_late",
    f"""
    WITH {_E}, s AS (SELECT TRY_CAST(json_extract_string(j, '$.event_ts') AS TIMESTAMP) AS ets, ts + to_minutes(CAST(event_id % 10 AS INTEGER)) AS arrival FROM e),
         a AS (SELECT count(ets) AS n, count(*) FILTER (arrival - ets > INTERVAL 5 MINUTE) AS late FROM s)
    SELECT {status_sql("late > 0")}, late AS violations, late AS late_rows, n AS total_rows FROM a
    """,
)
def json_late(t: Tables) -> DataFrame:
    e = _events(t).withColumn(
        "arrival", F.expr("ts + make_dt_interval(0, 0, CAST(event_id % 10 AS INT), 0)")
    )
    r = J.check_json_late(e, "payload", "$.event_ts", "arrival", 300)
    return verdict(r, late_rows="bigint", total_rows="bigint")


@query(
    "json_flatten",
    f"""
    WITH {_E}, a AS (SELECT count(*) AS n, CAST(coalesce(sum(json_array_length(j, '$.items')), 0) AS BIGINT) AS m FROM e)
    SELECT {status_sql("n <> m")}, abs(n - m) AS violations, n AS source_rows, m AS flattened_rows, abs(n - m) AS cardinality_diff FROM a
    """,
)
def json_flatten(t: Tables) -> DataFrame:
    r = J.check_flatten(_events(t), "payload", "$.items")
    return verdict(r, source_rows="bigint", flattened_rows="bigint", cardinality_diff="bigint")


_ITEMS = "i AS (SELECT event_id, CAST(json_extract_string(x, '$.pid') AS BIGINT) AS pid FROM (SELECT event_id, unnest(CAST(json_extract(j, '$.items') AS JSON[])) AS x FROM e WHERE json_exists(j, '$.items')))"


def _items(t: Tables) -> DataFrame:
    from tablecheck.functions.payloads import at_as

    base = J.explode_items(_events(t).select("event_id", "payload"), "payload", "$.items")
    return base.select("event_id", at_as(F.col("item"), "$.pid", "bigint").alias("pid"))


@query("json_explode", f"WITH {_E}, {_ITEMS} SELECT event_id, pid FROM i")
def json_explode(t: Tables) -> DataFrame:
    return _items(t)


@query(
    "json_flatten_child",
    f"""
    WITH {_E}, {_ITEMS},
         a AS (SELECT (SELECT CAST(coalesce(sum(json_array_length(j, '$.items')), 0) AS BIGINT) FROM e) AS n, (SELECT count(*) FROM i WHERE pid > 20) AS m)
    SELECT {status_sql("n <> m")}, abs(n - m) AS violations, n AS array_elements, m AS child_rows FROM a
    """,
)
def json_flatten_child(t: Tables) -> DataFrame:
    child = _items(t).filter("pid > 20")
    r = J.check_flatten_child(_events(t), "payload", "$.items", child)
    return verdict(r, array_elements="bigint", child_rows="bigint")


@query(
    "json_child_fk",
    f"""
    WITH {_E}, {_ITEMS},
         x AS (SELECT pid FROM i WHERE pid NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 500)),
         a AS (SELECT count(*) AS n, count(DISTINCT pid) AS k FROM x)
    SELECT {status_sql("n > 0")}, n AS violations, n AS orphan_rows, k AS orphan_keys FROM a
    """,
)
def json_child_fk(t: Tables) -> DataFrame:
    parent = t.customer.filter("c_acctbal > 500")
    r = J.check_json_child_fk(_events(t), "payload", "$.items", "$.pid", parent, "c_custkey")
    return verdict(r, orphan_rows="bigint", orphan_keys="bigint")


def _profile_sql(name: str, cond: str) -> str:
    return f"""
    {name}_k AS (SELECT unnest(json_keys(j)) AS key, j FROM e WHERE j IS NOT NULL AND {cond}),
    {name}_t AS (SELECT key, json_type(j, '$.' || key) AS jt, json_array_length(j, '$.' || key) AS len FROM {name}_k),
    {name} AS (SELECT key, CASE jt WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'BIGINT' THEN 'NUMBER' WHEN 'DOUBLE' THEN 'NUMBER' ELSE jt END AS type,
               count(*) AS n, CAST(sum(CASE WHEN jt = 'ARRAY' THEN len ELSE 0 END) AS BIGINT) AS length,
               (SELECT count(*) FROM e WHERE j IS NOT NULL AND {cond}) AS objects FROM {name}_t GROUP BY ALL)"""


@query(
    "json_drift",
    f"""
    WITH {_E}, {_profile_sql("c", "ts >= TIMESTAMP '2024-01-16'")}, {_profile_sql("b", "ts < TIMESTAMP '2024-01-16'")},
    x AS (SELECT coalesce(c.key, b.key) AS key, coalesce(c.type, b.type) AS type,
                 CASE WHEN b.n IS NULL THEN 'appeared' WHEN c.n IS NULL THEN 'vanished' ELSE 'both' END AS presence,
                 abs(coalesce(c.n / c.objects, 0) - coalesce(b.n / b.objects, 0)) AS pc,
                 CASE WHEN coalesce(c.type, b.type) = 'ARRAY' THEN abs(c.length / c.n - b.length / b.n) / greatest(b.length / b.n, 1) END AS lc
          FROM c FULL JOIN b ON c.key = b.key AND c.type = b.type)
    SELECT key, type, presence, round(pc, 6) AS presence_change, round(lc, 6) AS length_change,
           presence <> 'both' OR pc > 0.05 OR coalesce(lc > 0.5, false) AS drifted FROM x
    """,
)
def json_drift(t: Tables) -> DataFrame:
    cut = "timestamp_ntz'2024-01-16 00:00:00'"
    e = _events(t)
    rows = J.json_drift_rows(
        J.key_profile(e.filter(f"ts >= {cut}"), "payload"), J.key_profile(e.filter(f"ts < {cut}"), "payload")
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("presence_change", "length_change")})


@query(
    "project_paths",
    f"""
    WITH {_E}
    SELECT event_id, CAST(json_extract_string(j, '$.id') AS BIGINT) AS id, TRY_CAST(json_extract_string(j, '$.amount') AS DOUBLE) AS amount,
           json_extract_string(j, '$.status') AS status, CAST(json_extract_string(j, '$.user.uid') AS BIGINT) AS uid,
           TRY_CAST(json_extract_string(j, '$.event_ts') AS TIMESTAMP) AS event_ts FROM e
    """,
)
def project_paths(t: Tables) -> DataFrame:
    return J.project_paths(
        _events(t),
        "payload",
        {
            "id": ("$.id", "bigint"),
            "amount": ("$.amount", "double"),
            "status": ("$.status", "string"),
            "uid": ("$.user.uid", "bigint"),
            "event_ts": ("$.event_ts", "timestamp_ntz"),
        },
        keep=["event_id"],
    )


@query(
    "txspec_apply",
    f"""
    WITH {_E}, x AS (SELECT event_id, CAST(json_extract_string(j, '$.user.uid') AS BIGINT) AS uid, json_extract_string(j, '$.status') AS status,
                            TRY_CAST(json_extract_string(j, '$.amount') AS DOUBLE) AS amount, unnest(CAST(json_extract(j, '$.items') AS JSON[])) AS item
                     FROM e WHERE json_exists(j, '$.items')),
         y AS (SELECT event_id, uid, status, amount, CAST(json_extract_string(item, '$.pid') AS BIGINT) AS pid FROM x)
    SELECT event_id, uid, status, amount, pid,
           concat_ws(',', CASE WHEN abs(pid - uid) > 0.01 THEN 'same_user' END, CASE WHEN NOT amount < 50 THEN 'small' END) AS broken
    FROM y WHERE status IN ('click', 'view') AND pid > 3
    """,
)
def txspec_apply(t: Tables) -> DataFrame:
    spec = TxSpec(
        payload="payload",
        mapping={
            "uid": ("$.user.uid", "bigint"),
            "status": ("$.status", "string"),
            "amount": ("$.amount", "double"),
        },
        explode="$.items",
        item_mapping={"pid": ("$.pid", "bigint")},
        filters=[Filter("status", "in", ["click", "view"]), Filter("pid", "gt", 3)],
        rules={"same_user": "pid == uid", "small": "amount < 50"},
        keep=["event_id"],
    )
    out = apply_txspec(_events(t), spec)
    return out.withColumn("broken", F.concat_ws(",", "broken_rules")).drop("broken_rules")
