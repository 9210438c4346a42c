"""Data checks: keys, nulls, freshness, volume, rules, references, drift, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.operators import drift, integrity, intervals, rules, snapshots, volume
from tablecheck.plans.profile import profile, propose_keys

from .base import AS_OF, Tables, query, status_sql, verdict

# ------------------------------------------------------------------ uniqueness

_UNIQUE = """
WITH g AS (SELECT {keys}, count(*) AS n FROM {table} GROUP BY {keys})
SELECT CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'fail' ELSE 'pass' END AS status,
       CAST(count(*) FILTER (n > 1) AS BIGINT) AS violations,
       CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicate_groups,
       CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS total_duplicates,
       CAST(sum(n) AS BIGINT) AS total_rows
FROM g
"""
_UNIQUE_METRICS = {"duplicate_groups": "bigint", "total_duplicates": "bigint", "total_rows": "bigint"}


@query("unique_lineitem", _UNIQUE.format(keys="l_orderkey, l_linenumber", table="lineitem"))
def unique_lineitem(t: Tables) -> DataFrame:
    return verdict(integrity.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"]), **_UNIQUE_METRICS)


@query("unique_orders", _UNIQUE.format(keys="o_orderkey", table="orders"))
def unique_orders(t: Tables) -> DataFrame:
    return verdict(integrity.check_unique(t.orders, ["o_orderkey"]), **_UNIQUE_METRICS)


@query("unique_documents_text", _UNIQUE.format(keys="text", table="documents"))
def unique_documents_text(t: Tables) -> DataFrame:
    return verdict(integrity.check_unique(t.documents, ["text"]), **_UNIQUE_METRICS)


@query(
    "duplicate_rows_topk",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    ORDER BY duplicate_count DESC, l_orderkey, l_linenumber LIMIT 100
    """,
)
def duplicate_rows_topk(t: Tables) -> DataFrame:
    return integrity.top_duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], 100)


@query(
    "duplicate_rows",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE (l_orderkey, l_linenumber) IN
      (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    """,
)
def duplicate_rows(t: Tables) -> DataFrame:
    return integrity.duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )


# ----------------------------------------------------------------------- nulls


@query(
    "not_null_keys",
    """
    WITH s AS (SELECT nullif(l_orderkey % 11, 0) AS a, nullif(l_partkey % 13, 0) AS b FROM lineitem)
    SELECT CASE WHEN count(*) FILTER (a IS NULL OR b IS NULL) > 0 THEN 'fail' ELSE 'pass' END AS status,
           count(*) FILTER (a IS NULL OR b IS NULL) AS violations,
           count(*) AS total_rows,
           count(*) FILTER (a IS NULL) AS null_a, count(*) FILTER (b IS NULL) AS null_b
    FROM s
    """,
)
def not_null_keys(t: Tables) -> DataFrame:
    keyed = t.lineitem.select(
        F.expr("nullif(l_orderkey % 11, 0) AS a"), F.expr("nullif(l_partkey % 13, 0) AS b")
    )
    r = integrity.check_not_null(keyed, ["a", "b"])
    return verdict(
        r,
        total_rows="bigint",
        named={"null_a": ("null_count.a", "bigint"), "null_b": ("null_count.b", "bigint")},
    )


@query(
    "dim_complete",
    f"""
    WITH s AS (SELECT CASE WHEN c_custkey % 17 = 0 THEN '  ' WHEN c_custkey % 19 = 0 THEN NULL
                           ELSE c_name END AS nm, c_mktsegment AS seg FROM customer),
         b AS (SELECT count(*) FILTER (nm IS NULL OR trim(nm) = '' OR seg IS NULL OR trim(seg) = '') AS bad,
                      count(*) AS n FROM s)
    SELECT {status_sql("bad > 0")}, bad AS violations, bad AS incomplete_rows, n AS total_rows FROM b
    """,
)
def dim_complete(t: Tables) -> DataFrame:
    dim = t.customer.select(
        F.expr(
            "CASE WHEN c_custkey % 17 = 0 THEN '  ' WHEN c_custkey % 19 = 0 THEN NULL ELSE c_name END AS nm"
        ),
        F.col("c_mktsegment").alias("seg"),
    )
    return verdict(
        integrity.check_dim_complete(dim, ["nm", "seg"]), incomplete_rows="bigint", total_rows="bigint"
    )


# ------------------------------------------------------------------- freshness

_FRESH = """
WITH m AS (SELECT max(CASE WHEN event_type = 'error' THEN ts - INTERVAL 30 DAY ELSE ts END) AS newest FROM events),
     l AS (SELECT newest, {fn}('hour', newest, TIMESTAMP '2024-01-31 00:00:00') AS lag FROM m)
SELECT CASE WHEN lag <= {hours} THEN 'pass' ELSE 'fail' END AS status,
       CAST(greatest(0, lag - {hours}) AS BIGINT) AS violations,
       CAST(lag AS DOUBLE) AS observed, newest AS max_timestamp FROM l
"""


def _late_errors(t: Tables) -> DataFrame:
    """All events; errors count as thirty days older."""
    return t.events.withColumn("ts", F.expr("ts - make_dt_interval(IF(event_type = 'error', 30, 0))"))


@query("freshness_events", _FRESH.format(fn="date_diff", hours=24))
def freshness_events(t: Tables) -> DataFrame:
    r = volume.check_fresh(_late_errors(t), "ts", 24, AS_OF)
    return verdict(r, "observed", max_timestamp="timestamp_ntz")


@query("freshness_elapsed", _FRESH.format(fn="date_sub", hours=0))
def freshness_elapsed(t: Tables) -> DataFrame:
    r = volume.check_fresh(_late_errors(t), "ts", 0, AS_OF, elapsed=True)
    return verdict(r, "observed", max_timestamp="timestamp_ntz")


# --------------------------------------------------------------------- volumes


@query(
    "row_count_range",
    f"""
    WITH c AS (SELECT count(*) AS n FROM orders)
    SELECT {status_sql("n < 100 OR n > 1000")},
           greatest(0, 100 - n) + greatest(0, n - 1000) AS violations, n AS row_count FROM c
    """,
)
def row_count_range(t: Tables) -> DataFrame:
    r = volume.check_row_count(t.orders, 100, 1000)
    return verdict(r, row_count="bigint")


@query(
    "row_count_stable",
    f"""
    WITH c AS (SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n,
                      count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS b FROM events)
    SELECT {status_sql("abs(n - b) * 100.0 / b > 10")},
           CASE WHEN abs(n - b) * 100.0 / b > 10 THEN abs(n - b) ELSE 0 END AS violations,
           n AS row_count, b AS baseline FROM c
    """,
)
def row_count_stable(t: Tables) -> DataFrame:
    first = t.events.filter("ts < timestamp_ntz'2024-01-16 00:00:00'")
    second = t.events.filter("ts >= timestamp_ntz'2024-01-16 00:00:00'")
    baseline = first.agg(F.count(F.lit(1)).alias("n")).scalar()
    r = volume.check_row_count_stable(second, baseline, 10.0)
    return verdict(r, row_count="bigint", baseline="bigint")


@query(
    "count_match",
    f"""
    WITH c AS (SELECT (SELECT count(*) FROM orders) AS a,
                      (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS b)
    SELECT {status_sql("abs(a - b) * 100.0 > b * 5.0")},
           CASE WHEN abs(a - b) * 100.0 > b * 5.0 THEN abs(a - b) ELSE 0 END AS violations,
           a AS row_count, b AS other_count FROM c
    """,
)
def count_match(t: Tables) -> DataFrame:
    r = volume.check_count_match(t.orders, t.lineitem.select("l_orderkey").distinct(), 0, 5.0)
    return verdict(r, row_count="bigint", other_count="bigint")


_AGG_SOURCE = "SELECT CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'Z' ELSE l_returnflag END AS l_returnflag, l_linestatus, l_quantity * 1.001 AS q, l_extendedprice AS p FROM lineitem"


@query(
    "agg_match_total",
    f"""
    WITH s AS (SELECT l_quantity + CASE WHEN l_orderkey % 100 = 0 THEN 1 ELSE 0 END AS q, l_extendedprice AS p FROM lineitem),
         a AS (SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qa,
                      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS pa FROM lineitem),
         b AS (SELECT CAST(sum(CAST(q AS DECIMAL(18,4))) AS DOUBLE) AS qb,
                      CAST(sum(CAST(p AS DECIMAL(18,4))) AS DOUBLE) AS pb FROM s),
         o AS (SELECT CASE WHEN abs(qa - qb) > 0.01 THEN 1 ELSE 0 END + CASE WHEN abs(pa - pb) > 0.01 THEN 1 ELSE 0 END AS n FROM a, b)
    SELECT {status_sql("n > 0")}, CAST(n AS BIGINT) AS violations, CAST(n AS BIGINT) AS mismatches FROM o
    """,
)
def agg_match_total(t: Tables) -> DataFrame:
    source = t.lineitem.select(
        F.expr("l_quantity + CASE WHEN l_orderkey % 100 = 0 THEN 1 ELSE 0 END AS q"),
        F.col("l_extendedprice").alias("p"),
    )
    actual = t.lineitem.select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    r = volume.check_agg_match(actual, source, {"qty": ("sum", "q"), "price": ("sum", "p")})
    return verdict(r, mismatches="bigint")


@query(
    "agg_match_group",
    f"""
    WITH s AS ({_AGG_SOURCE}),
         a AS (SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qa,
                      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS pa, 1 AS ia FROM lineitem GROUP BY ALL),
         b AS (SELECT l_returnflag, l_linestatus, CAST(sum(CAST(q AS DECIMAL(18,4))) AS DOUBLE) AS qb,
                      CAST(sum(CAST(p AS DECIMAL(18,4))) AS DOUBLE) AS pb, 1 AS ib FROM s GROUP BY ALL)
    SELECT l_returnflag, l_linestatus,
           CASE WHEN ia = 1 AND ib = 1 THEN 'both' WHEN ia = 1 THEN 'actual_only' ELSE 'expected_only' END AS present,
           qa AS qty_actual, qb AS qty_expected,
           coalesce(ia = 1 AND ib = 1 AND (abs(qa - qb) <= 0.01 OR abs(qa - qb) * 100 <= 0.2 * abs(qb)), false) AS qty_ok,
           pa AS price_actual, pb AS price_expected,
           coalesce(ia = 1 AND ib = 1 AND (abs(pa - pb) <= 0.01 OR abs(pa - pb) * 100 <= 0.2 * abs(pb)), false) AS price_ok
    FROM a FULL JOIN b USING (l_returnflag, l_linestatus)
    """,
)
def agg_match_group(t: Tables) -> DataFrame:
    source = t.lineitem.select(
        F.expr("IF(l_linestatus = 'F' AND l_returnflag = 'A', 'Z', l_returnflag) AS l_returnflag"),
        "l_linestatus",
        F.expr("l_quantity * 1.001D AS q"),
        F.col("l_extendedprice").alias("p"),
    )
    actual = t.lineitem.select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p")
    )
    return volume.agg_match_frame(
        actual,
        source,
        {"qty": ("sum", "q"), "price": ("sum", "p")},
        ["l_returnflag", "l_linestatus"],
        abs_tol=0.01,
        pct=0.2,
    )


# ----------------------------------------------------------------------- rules

_ORDER_TOTALS = """
o AS (SELECT o_orderkey, o_totalprice, coalesce(items, 0) AS items FROM orders LEFT JOIN
        (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS items
         FROM lineitem GROUP BY l_orderkey) i ON o_orderkey = l_orderkey)
"""


def _order_totals(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("items")
    )
    joined = t.orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "o_totalprice", F.coalesce("items", F.lit(0.0)).alias("items"))


@query(
    "rule_total",
    f"""
    WITH {_ORDER_TOTALS},
         d AS (SELECT abs(o_totalprice - items) AS diff, abs(CAST(o_totalprice AS DECIMAL(18,4)) - CAST(items AS DECIMAL(18,4))) > 0.01 AS bad FROM o),
         a AS (SELECT count(*) FILTER (bad) AS n, count(*) AS total,
                      CAST(sum(CASE WHEN bad THEN CAST(diff AS DECIMAL(18,4)) END) AS DOUBLE) AS s FROM d)
    SELECT {status_sql("n > 0")}, n AS violations, s / n AS avg_difference, total AS total_rows FROM a
    """,
)
def rule_total(t: Tables) -> DataFrame:
    r = rules.check_rule(_order_totals(t), "o_totalprice == items", 0.01)
    return verdict(r, avg_difference="double", total_rows="bigint")


@query(
    "rule_rows",
    f"""
    WITH {_ORDER_TOTALS}
    SELECT o_orderkey, o_totalprice, items FROM o WHERE abs(o_totalprice - items) > 100000
    """,
)
def rule_rows(t: Tables) -> DataFrame:
    return rules.rule_rows(_order_totals(t), "o_totalprice == items", 100000)


@query(
    "rule_pct",
    f"""
    WITH d AS (SELECT n_chars, length(text) + CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 0 END AS expected FROM documents),
         a AS (SELECT count(*) FILTER (abs(n_chars - expected) > 10 AND abs(n_chars - expected) * 100 > 5 * expected) AS n,
                      count(*) AS total FROM d)
    SELECT {status_sql("n > 0")}, n AS violations, total AS total_rows FROM a
    """,
)
def rule_pct(t: Tables) -> DataFrame:
    docs = t.documents.select(
        "n_chars", F.expr("length(text) + CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 0 END AS expected")
    )
    return verdict(rules.check_rule(docs, "n_chars == expected", 10, 5.0), total_rows="bigint")


@query(
    "rule_condition",
    f"""
    WITH a AS (SELECT count(*) FILTER (NOT (l_discount <= 0.09 AND l_quantity > 1)) AS n, count(*) AS total FROM lineitem)
    SELECT {status_sql("n > 0")}, n AS violations, total AS total_rows FROM a
    """,
)
def rule_condition(t: Tables) -> DataFrame:
    return verdict(
        rules.check_rule(t.lineitem, "l_discount <= 0.09D AND l_quantity > 1"), total_rows="bigint"
    )


@query(
    "rule_compound",
    f"""
    WITH a AS (SELECT count(*) FILTER (NOT (l_tax = l_discount AND l_quantity > 10)) AS n, count(*) AS total FROM lineitem)
    SELECT {status_sql("n > 0")}, n AS violations, total AS total_rows FROM a
    """,
)
def rule_compound(t: Tables) -> DataFrame:
    """An equality below the top is no rule of its own: it has no tolerance."""
    return verdict(rules.check_rule(t.lineitem, "l_tax == l_discount AND l_quantity > 10"), total_rows="bigint")


@query(
    "rule_text",
    """
    SELECT 'status' AS rule, count(*) FILTER (l_linestatus <> CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END) AS violations,
           CAST(NULL AS DOUBLE) AS avg_difference FROM lineitem
    UNION ALL SELECT 'dates', count(*) FILTER (CAST(l_shipdate AS DATE) <> DATE '1995-06-17'), NULL FROM lineitem
    UNION ALL SELECT 'equals inside a text', count(*) FILTER (l_linestatus || ' == ' <> 'F == '), NULL FROM lineitem
    """,
)
def rule_text(t: Tables) -> DataFrame:
    named = {
        "status": "l_linestatus == CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END",
        "dates": "date(l_shipdate) == date'1995-06-17'",
        "equals inside a text": "concat(l_linestatus, ' == ') == 'F == '",
    }
    made = [
        verdict(rules.check_rule(t.lineitem, text), avg_difference="double")
        .drop("status")
        .withColumn("rule", F.lit(name))
        for name, text in named.items()
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(
    "agg_match_times",
    """
    WITH a AS (SELECT l_returnflag, min(l_shipdate) AS lo, max(l_linestatus) AS s, count(*) AS n, sum(l_orderkey) AS k FROM lineitem GROUP BY 1),
         b AS (SELECT l_returnflag, min(l_shipdate) AS lo, max(l_linestatus) AS s, count(*) AS n, sum(l_orderkey) AS k FROM lineitem
               WHERE NOT (l_returnflag = 'A' AND l_orderkey % 2 = 0) GROUP BY 1)
    SELECT l_returnflag, a.lo = b.lo AS lo_ok, a.s = b.s AS s_ok, a.n = b.n AS n_ok, a.k = b.k AS k_ok,
           a.k::BIGINT AS k_actual, b.k::BIGINT AS k_expected FROM a JOIN b USING (l_returnflag)
    """,
)
def agg_match_times(t: Tables) -> DataFrame:
    """Times, texts and whole numbers in their own types, without a tolerance."""
    metrics = {"lo": ("min", "l_shipdate"), "s": ("max", "l_linestatus"), "n": ("count", "*"), "k": ("sum", "l_orderkey")}
    part = t.lineitem.filter("NOT (l_returnflag = 'A' AND l_orderkey % 2 = 0)")
    out = volume.agg_match_frame(t.lineitem, part, metrics, ["l_returnflag"], abs_tol=0)
    return out.select("l_returnflag", "lo_ok", "s_ok", "n_ok", "k_ok", "k_actual", "k_expected")


@query(
    "allowed_values",
    f"""
    WITH a AS (SELECT count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS n FROM orders)
    SELECT {status_sql("n > 0")}, n AS violations FROM a
    """,
)
def allowed_values(t: Tables) -> DataFrame:
    return verdict(
        integrity.check_allowed_values(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    )


@query(
    "allowed_values_lookup",
    f"""
    WITH a AS (SELECT count(*) AS n, count(DISTINCT l_partkey) AS k FROM lineitem
               WHERE l_partkey NOT IN (SELECT CASE WHEN p_size > 5 THEN p_partkey ELSE -p_partkey END FROM part))
    SELECT {status_sql("n > 0")}, n AS violations, k AS unknown_values FROM a
    """,
)
def allowed_values_lookup(t: Tables) -> DataFrame:
    lookup = t.part.select(F.expr("IF(p_size > 5, p_partkey, -p_partkey) AS value"))
    return verdict(
        integrity.check_allowed_values(t.lineitem, "l_partkey", lookup), unknown_values="bigint"
    )


@query(
    "invariant_balance",
    f"""
    WITH a AS (SELECT count(*) FILTER (c_acctbal < 0) AS n, count(*) AS total FROM customer)
    SELECT {status_sql("n > 0")}, n AS violations, total AS checked_rows FROM a
    """,
)
def invariant_balance(t: Tables) -> DataFrame:
    return verdict(integrity.check_invariant(t.customer, "c_acctbal >= 0"), checked_rows="bigint")


@query(
    "array_length_invariant",
    f"""
    WITH a AS (SELECT count(*) FILTER (len(embedding) <> 64 OR label > 7) AS n, count(*) AS total FROM embeddings)
    SELECT {status_sql("n > 0")}, n AS violations, total AS checked_rows FROM a
    """,
)
def array_length_invariant(t: Tables) -> DataFrame:
    return verdict(
        integrity.check_invariant(t.embeddings, "size(embedding) = 64 AND label <= 7"), checked_rows="bigint"
    )


# ------------------------------------------------------------------ references


def _renumbered(t: Tables) -> DataFrame:
    """Orders, some under another key, so that line items lose their parent."""
    return t.orders.withColumn(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_orderkey ELSE o_orderkey END")
    )


@query(
    "fk_orphans",
    f"""
    WITH x AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL AND
               l_orderkey NOT IN (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_orderkey ELSE o_orderkey END FROM orders)),
         a AS (SELECT count(*) AS n, count(DISTINCT l_orderkey) AS k FROM x)
    SELECT {status_sql("n > 0")}, n AS violations, n AS orphan_rows, k AS orphan_keys FROM a
    """,
)
def fk_orphans(t: Tables) -> DataFrame:
    r = integrity.check_foreign_key(t.lineitem, ["l_orderkey"], _renumbered(t), ["o_orderkey"])
    return verdict(r, orphan_rows="bigint", orphan_keys="bigint")


@query(
    "fk_composite",
    f"""
    WITH p AS (SELECT DISTINCT CASE WHEN l_linenumber < 4 THEN l_partkey ELSE -l_partkey END AS l_partkey, l_suppkey FROM lineitem),
         c AS (SELECT l_partkey, nullif(l_suppkey, 3) AS s FROM lineitem),
         x AS (SELECT c.l_partkey, c.s FROM c WHERE c.s IS NOT NULL AND NOT EXISTS
               (SELECT 1 FROM p WHERE p.l_partkey = c.l_partkey AND p.l_suppkey = c.s)),
         a AS (SELECT count(*) AS n, count(DISTINCT (l_partkey, s)) AS k FROM x)
    SELECT {status_sql("n > 0")}, n AS violations, n AS orphan_rows, k AS orphan_keys FROM a
    """,
)
def fk_composite(t: Tables) -> DataFrame:
    parent = t.lineitem.select(F.expr("IF(l_linenumber < 4, l_partkey, -l_partkey) AS l_partkey"), "l_suppkey")
    child = t.lineitem.select("l_partkey", F.expr("nullif(l_suppkey, 3) AS s"))
    r = integrity.check_foreign_key(child, ["l_partkey", "s"], parent, ["l_partkey", "l_suppkey"])
    return verdict(r, orphan_rows="bigint", orphan_keys="bigint")


@query(
    "fact_coverage",
    f"""
    WITH j AS (SELECT o_orderkey IS NOT NULL AS a, p_partkey IS NOT NULL AS b, s_suppkey IS NOT NULL AS c FROM lineitem
               LEFT JOIN (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey FROM orders) o ON l_orderkey = o_orderkey
               LEFT JOIN (SELECT CASE WHEN p_size = 9 THEN -p_partkey ELSE p_partkey END AS p_partkey FROM part) p ON l_partkey = p_partkey
               LEFT JOIN (SELECT CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey END AS s_suppkey FROM supplier) s ON l_suppkey = s_suppkey),
         g AS (SELECT count(*) AS n, count(*) FILTER (a AND b AND c) AS ok, count(*) FILTER (NOT a) AS na,
                      count(*) FILTER (NOT b) AS nb, count(*) FILTER (NOT c) AS nc FROM j)
    SELECT {status_sql("ok < n")}, n - ok AS violations, n AS total_rows, ok AS covered_rows,
           na AS missing_order, nb AS missing_part, nc AS missing_supplier FROM g
    """,
)
def fact_coverage(t: Tables) -> DataFrame:
    r = integrity.check_fact_coverage(
        t.lineitem,
        [
            (["l_orderkey"], _renumbered(t), ["o_orderkey"]),
            (["l_partkey"], t.part.select(F.expr("IF(p_size = 9, -p_partkey, p_partkey) AS p_partkey")), ["p_partkey"]),
            (["l_suppkey"], t.supplier.select(F.expr("IF(s_acctbal > 0, s_suppkey, -s_suppkey) AS s_suppkey")), ["s_suppkey"]),
        ],
    )
    return verdict(
        r,
        total_rows="bigint",
        covered_rows="bigint",
        named={
            "missing_order": ("missing.l_orderkey", "bigint"),
            "missing_part": ("missing.l_partkey", "bigint"),
            "missing_supplier": ("missing.l_suppkey", "bigint"),
        },
    )


@query(
    "idempotent_load",
    f"""
    WITH e AS (SELECT event_id - CASE WHEN event_id % 97 = 0 THEN 96 ELSE 0 END AS id, CAST(ts AS DATE) AS batch FROM events),
         g AS (SELECT id, count(*) AS n FROM e GROUP BY id HAVING count(DISTINCT batch) > 1),
         a AS (SELECT count(*) AS k, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM g)
    SELECT {status_sql("k > 0")}, k AS violations, k AS reloaded_ids, n AS reloaded_rows FROM a
    """,
)
def idempotent_load(t: Tables) -> DataFrame:
    loads = t.events.select(
        F.expr("event_id - CASE WHEN event_id % 97 = 0 THEN 96 ELSE 0 END AS id"),
        F.to_date("ts").alias("batch"),
    )
    r = integrity.check_idempotent(loads, "id", "batch")
    return verdict(r, reloaded_ids="bigint", reloaded_rows="bigint")


# -------------------------------------------------------------- profile, drift

_PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _profile_line(c: str, kind: str) -> str:
    num = kind in ("bigint", "double")
    d = f"CAST({c} AS DECIMAL(18,4))" if kind == "double" else c
    avg = f"CAST(sum({d}) AS DOUBLE) / count({c})" if num else "CAST(NULL AS DOUBLE)"

    def text(fn: str) -> str:
        found = f"CAST({fn}({c}) AS VARCHAR)"
        return f"regexp_replace({found}, '\\.0$', '')" if kind == "double" else found

    return (
        f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"CAST((count(*) - count({c})) / count(*) AS DOUBLE) AS null_rate, count(DISTINCT {c}) AS distinct_count, "
        f"{text('min')} AS min, {text('max')} AS max, {avg} AS avg FROM s"
    )


_PROFILE_SQL = (
    "WITH s AS (SELECT o_orderkey, nullif(o_custkey, 5) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders) "
    + " UNION ALL ".join(
        _profile_line(c, k)
        for c, k in zip(_PROFILED, ("bigint", "bigint", "string", "double", "timestamp", "string"))
    )
)


@query("profile_orders", _PROFILE_SQL)
def profile_orders(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("o_custkey", F.expr("nullif(o_custkey, 5)"))
    return profile(orders, "orders", _PROFILED, exact_distinct=True).drop("dataset", "type", "stddev")


@query(
    "key_candidates",
    " UNION ALL ".join(
        f"SELECT 'events' AS dataset, '{c}' AS \"column\", count(*) AS row_count, count(DISTINCT {c}) AS distinct_count "
        f"FROM events HAVING count(*) = count(DISTINCT {c})"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)
def key_candidates(t: Tables) -> DataFrame:
    return propose_keys(t.events, "events")


_HALF = "timestamp_ntz'2024-01-16 00:00:00'"


@query(
    "profile_drift",
    """
    WITH c AS (SELECT CAST(sum(CAST(value * 1.2 AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS a, count(DISTINCT user_id) AS d, stddev(value) AS s,
                      CAST(sum(user_id) AS DOUBLE) / count(*) AS ua, stddev(user_id) AS us, count(DISTINCT value * 1.2) AS vd
               FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
         b AS (SELECT CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS a, count(DISTINCT user_id) AS d, stddev(value) AS s,
                      CAST(sum(user_id) AS DOUBLE) / count(*) AS ua, stddev(user_id) AS us, count(DISTINCT value) AS vd
               FROM events WHERE ts < TIMESTAMP '2024-01-16'),
         x AS (SELECT 'value' AS "column", abs(c.a - b.a) / b.s AS shift, abs(c.vd - b.vd) / b.vd AS dc FROM c, b
               UNION ALL SELECT 'user_id', abs(c.ua - b.ua) / b.us, abs(c.d - b.d) / b.d FROM c, b)
    SELECT "column", true AS present, CAST(0 AS DOUBLE) AS null_rate_change, round(shift, 6) AS mean_shift, round(dc, 6) AS distinct_change,
           (shift > 0.05 OR dc > 0.5) AS drifted FROM x
    """,
)
def profile_drift(t: Tables) -> DataFrame:
    cols = ["value", "user_id"]
    first = t.events.filter(f"ts < {_HALF}")
    second = t.events.filter(f"ts >= {_HALF}").withColumn("value", F.col("value") * F.lit(1.2))
    out = drift.profile_drift_rows(
        profile(second, "events", cols, True), profile(first, "events", cols, True), max_mean_shift=0.05
    )
    return out.withColumns(
        {c: F.round(c, 6) for c in ("null_rate_change", "mean_shift", "distinct_change")}
    )


def _psi_sql(current: str, base: str) -> str:
    return f"""
    WITH c AS ({current}), b AS ({base}),
         u AS (SELECT k, sum(x) AS x, sum(y) AS y FROM
                 (SELECT k, 1 AS x, 0 AS y FROM c UNION ALL SELECT k, 0, 1 FROM b) GROUP BY k),
         s AS (SELECT greatest(x / (SELECT sum(x) FROM u), 0.0001) AS p, greatest(y / (SELECT sum(y) FROM u), 0.0001) AS q, x, y FROM u),
         a AS (SELECT sum((p - q) * ln(p / q)) AS psi, count(*) AS n, count(*) FILTER (y = 0) AS appeared, count(*) FILTER (x = 0) AS vanished FROM s)
    SELECT CASE WHEN psi <= 0.2 THEN 'pass' ELSE 'fail' END AS status,
           CAST(CASE WHEN psi <= 0.2 THEN 0 ELSE 1 END AS BIGINT) AS violations, round(psi, 6) AS psi,
           n AS categories, appeared, vanished FROM a
    """


def _psi(r: DataFrame) -> DataFrame:
    out = verdict(r, "observed", **_PSI_METRICS)
    return out.withColumn("psi", F.round("observed", 6)).drop("observed")


_PSI_METRICS = {"categories": "bigint", "appeared": "bigint", "vanished": "bigint"}


@query(
    "category_psi",
    _psi_sql(
        "SELECT CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END AS k FROM events WHERE ts >= TIMESTAMP '2024-01-16'",
        "SELECT event_type AS k FROM events WHERE ts < TIMESTAMP '2024-01-16'",
    ),
)
def category_psi(t: Tables) -> DataFrame:
    first = t.events.filter(f"ts < {_HALF}")
    second = t.events.filter(f"ts >= {_HALF}").withColumn(
        "event_type", F.expr("CASE WHEN event_id % 5 = 0 THEN 'other' ELSE event_type END")
    )
    r = drift.check_category_drift(second, first, "event_type")
    return _psi(r)


_BIN = "CAST(greatest(-1, least(10, floor((v - (SELECT min(o_totalprice) FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01') * 10))) AS BIGINT)"


@query(
    "numeric_psi",
    _psi_sql(
        f"SELECT {_BIN} AS k FROM (SELECT o_totalprice * 1.3 AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01')",
        f"SELECT {_BIN} AS k FROM (SELECT o_totalprice AS v FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01')",
    ),
)
def numeric_psi(t: Tables) -> DataFrame:
    cut = "timestamp_ntz'1995-06-01 00:00:00'"
    base = t.orders.filter(f"o_orderdate < {cut}").select(F.col("o_totalprice").alias("v"))
    cur = t.orders.filter(f"o_orderdate >= {cut}").select((F.col("o_totalprice") * F.lit(1.3)).alias("v"))
    r = drift.check_category_drift(cur, base, "v", bins=10)
    return _psi(r)


def _whole_bin(base: str) -> str:
    return f"CAST(greatest(-1, least(10, floor((event_id - (SELECT min(event_id) FROM {base})) / (SELECT max(event_id) - min(event_id) FROM {base}) * 10))) AS BIGINT)"


@query(
    "whole_number_psi",
    _psi_sql(
        f"SELECT {_whole_bin('(SELECT event_id FROM events WHERE user_id % 2 = 0)')} AS k FROM events WHERE user_id % 2 = 1",
        f"SELECT {_whole_bin('(SELECT event_id FROM events WHERE user_id % 2 = 0)')} AS k FROM events WHERE user_id % 2 = 0",
    ),
)
def whole_number_psi(t: Tables) -> DataFrame:
    """Users with even against users with odd numbers; ids are binned, not categories."""
    r = drift.check_category_drift(t.events.filter("user_id % 2 = 1"), t.events.filter("user_id % 2 = 0"), "event_id")
    return _psi(r)


@query(
    "category_psi_lang",
    _psi_sql(
        "SELECT lang AS k FROM documents WHERE source >= 'src5'",
        "SELECT lang AS k FROM documents WHERE source < 'src5'",
    ),
)
def category_psi_lang(t: Tables) -> DataFrame:
    r = drift.check_category_drift(
        t.documents.filter("source >= 'src5'"), t.documents.filter("source < 'src5'"), "lang"
    )
    return _psi(r)


# ------------------------------------------------------- intervals and lateness


def _arrivals(t: Tables) -> DataFrame:
    return t.events.withColumn(
        "arrival", F.expr("ts + make_dt_interval(0, 0, CAST(event_id % 10 AS INT), 0)")
    )


@query(
    "late_rate",
    """
    WITH e AS (SELECT ts, ts + to_minutes(CAST(event_id % 10 AS INTEGER)) AS arrival FROM events),
         a AS (SELECT count(*) FILTER (arrival - ts > INTERVAL 5 MINUTE) AS late, count(*) AS n FROM e)
    SELECT CASE WHEN late / n <= 0.1 THEN 'pass' ELSE 'fail' END AS status,
           CASE WHEN late / n <= 0.1 THEN 0 ELSE late END AS violations, late AS late_rows, n AS total_rows,
           late / n AS late_rate FROM a
    """,
)
def late_rate(t: Tables) -> DataFrame:
    r = intervals.check_late_arrivals(_arrivals(t), "ts", "arrival", 300, 0.1)
    return verdict(r, late_rows="bigint", total_rows="bigint", late_rate="double")


_RUNNING_MAX = """
WITH e AS (SELECT event_id, event_type, ts - CASE WHEN event_id % 13 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS ets FROM events),
     w AS (SELECT *, max(ets) OVER (PARTITION BY event_type ORDER BY event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e)
SELECT event_id, event_type, coalesce(newest - ets > INTERVAL 1 HOUR, false) AS late FROM w
"""


@query("late_running_max", _RUNNING_MAX)
def late_running_max(t: Tables) -> DataFrame:
    e = t.events.select(
        "event_id",
        "event_type",
        F.expr("ts - make_dt_interval(0, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END, 0, 0) AS ets"),
    )
    return intervals.behind_running_max(
        e, "ets", "event_id", "event_type", sla_seconds=3600
    ).select("event_id", "event_type", "late")


@query("late_running_max_cut", _RUNNING_MAX)
def late_running_max_cut(t: Tables) -> DataFrame:
    """The same with event types cut into buckets."""
    e = t.events.select(
        "event_id",
        "event_type",
        F.expr("ts - make_dt_interval(0, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 0 END, 0, 0) AS ets"),
    )
    out = intervals.behind_running_max(e, "ets", "event_id", "event_type", 3600, hot_rows=100, bucket_rows=50)
    return out.select("event_id", "event_type", "late")


_SCD2 = f"""
WITH b AS (SELECT o_custkey AS k, o_orderdate AS s,
                  CASE WHEN o_orderkey % 50 = 0 THEN NULL
                       ELSE o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) END AS e FROM orders),
     f AS (SELECT k, s, e, coalesce(e, TIMESTAMP '9999-12-31') AS x FROM b),
     w AS (SELECT *, max(x) OVER (PARTITION BY k ORDER BY s, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM f),
     o AS (SELECT count(*) AS m FROM (SELECT k FROM f WHERE e IS NULL GROUP BY k HAVING count(*) > 1)),
     a AS (SELECT count(*) FILTER (pm > s) AS lap, count(*) FILTER (pm < s) AS gaps, count(*) FILTER (s >= x) AS inverted,
                  (SELECT m FROM o) AS multi, count(*) AS n FROM w)
SELECT {status_sql("lap + gaps + inverted + multi > 0")}, lap + gaps + inverted + multi AS violations,
       lap AS "overlaps", gaps, inverted, multi AS keys_with_several_open_rows, n AS total_rows FROM a
"""


def _history(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("k"),
        F.col("o_orderdate").alias("s"),
        F.expr(
            "CASE WHEN o_orderkey % 50 = 0 THEN NULL "
            "ELSE o_orderdate + make_dt_interval(CAST(o_orderkey % 400 AS INT), 0, 0, 0) END AS e"
        ),
    )


def _scd2(t: Tables, **cuts: int) -> DataFrame:
    return verdict(
        intervals.check_scd2(_history(t), "k", "s", "e", **cuts),
        overlaps="bigint",
        gaps="bigint",
        inverted="bigint",
        keys_with_several_open_rows="bigint",
        total_rows="bigint",
    )


@query("scd2_intervals", _SCD2)
def scd2_intervals(t: Tables) -> DataFrame:
    return _scd2(t)


@query("scd2_intervals_cut", _SCD2)
def scd2_intervals_cut(t: Tables) -> DataFrame:
    """The same with customers of more than five orders cut into buckets."""
    return _scd2(t, hot_rows=5, bucket_rows=4)


# -------------------------------------------------------------------- snapshots

_SNAP_CUR = """
c AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
             CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
      FROM orders),
p AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)
"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    prev = t.orders.select(*cols)
    cur = prev.withColumns(
        {
            "o_orderkey": F.expr(
                "CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END"
            ),
            "o_custkey": F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END"),
            "o_orderstatus": F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END"),
        }
    )
    return cur, prev


@query(
    "snapshot_compare",
    f"""
    WITH {_SNAP_CUR},
         j AS (SELECT c.o_orderkey AS a, p.o_orderkey AS b, c.o_custkey <> p.o_custkey AS k, c.o_orderstatus <> p.o_orderstatus AS s
               FROM c FULL JOIN p ON c.o_orderkey = p.o_orderkey),
         x AS (SELECT count(*) FILTER (b IS NULL) AS added, count(*) FILTER (a IS NULL) AS removed,
                      count(*) FILTER (k OR s) AS changed, count(*) FILTER (k) AS ck, count(*) FILTER (s) AS cs FROM j)
    SELECT {status_sql("added + removed + changed > 0")}, added + removed + changed AS violations, added, removed, changed,
           ck AS changed_custkey, cs AS changed_status FROM x
    """,
)
def snapshot_compare(t: Tables) -> DataFrame:
    cur, prev = _snapshots(t)
    r = snapshots.compare_snapshots(cur, prev, ["o_orderkey"])
    return verdict(
        r,
        added="bigint",
        removed="bigint",
        changed="bigint",
        named={
            "changed_custkey": ("changed.o_custkey", "bigint"),
            "changed_status": ("changed.o_orderstatus", "bigint"),
        },
    )


@query(
    "snapshot_except",
    f"""
    WITH {_SNAP_CUR}
    SELECT 'current_only' AS side, 1 AS copies, * FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM p)
    UNION ALL SELECT 'previous_only', 1, * FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM c)
    """,
)
def snapshot_except(t: Tables) -> DataFrame:
    cur, prev = _snapshots(t)
    return snapshots.except_both(cur, prev)


@query(
    "failure_profile",
    """
    WITH v AS (SELECT c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nk FROM customer WHERE c_acctbal < 0),
         u AS (SELECT 'c_mktsegment' AS dimension, c_mktsegment AS value FROM v UNION ALL SELECT 'c_nationkey', nk FROM v),
         g AS (SELECT dimension, value, count(*) AS violations FROM u GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY violations DESC, value) AS rank FROM g) WHERE rank <= 5
    """,
)
def failure_profile(t: Tables) -> DataFrame:
    bad = integrity.invariant_rows(t.customer, "c_acctbal >= 0")
    return snapshots.failure_profile(bad, ["c_mktsegment", "c_nationkey"], 5)
