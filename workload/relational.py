"""Filters, windows, joins, aggregation, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions.predicates import (
    Filter,
    apply_filters,
    window_batch,
    window_last,
    window_range,
)
from tablecheck.operators import joins
from tablecheck.operators.aggregates import ir_aggregate
from tablecheck.plans.budget import auto_sample

from .base import AS_OF, Tables, query


@query(
    "filters_all",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus <> 'O' AND l_linenumber IN (1, 2, 3) AND l_suppkey NOT IN (5, 6)
      AND l_quantity > 5 AND l_quantity < 45 AND l_discount >= 0.02 AND l_tax <= 0.06
    """,
)
def filters_all(t: Tables) -> DataFrame:
    return apply_filters(
        t.lineitem,
        [
            Filter("l_returnflag", "equals", "R"),
            Filter("l_linestatus", "not_equals", "O"),
            Filter("l_linenumber", "in", [1, 2, 3]),
            Filter("l_suppkey", "not_in", [5, 6]),
            Filter("l_quantity", "gt", 5),
            Filter("l_quantity", "lt", 45),
            Filter("l_discount", "gte", 0.02),
            Filter("l_tax", "lte", 0.06),
        ],
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


@query(
    "window_last_days",
    """
    SELECT event_id, ts FROM events
    WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-31 00:00:00'
    """,
)
def window_last_days(t: Tables) -> DataFrame:
    return window_last(t.events, "ts", days=7, as_of=AS_OF).select("event_id", "ts")


@query(
    "window_last_hours",
    """
    SELECT event_id, ts FROM events
    WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 36 HOUR AND ts <= TIMESTAMP '2024-01-31 00:00:00'
    """,
)
def window_last_hours(t: Tables) -> DataFrame:
    return window_last(t.events, "ts", hours=36, as_of=AS_OF).select("event_id", "ts")


@query(
    "window_range",
    """
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
    """,
)
def window_range_(t: Tables) -> DataFrame:
    return window_range(t.orders, "o_orderdate", "1996-01-01", "1997-01-01").select("o_orderkey", "o_orderdate")


@query("window_batch", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def window_batch_(t: Tables) -> DataFrame:
    return window_batch(t.documents, "source", "src3").select("doc_id", "lang", "n_chars")


_CUST = "(SELECT CASE WHEN c_acctbal > 2000 THEN c_custkey ELSE -1000000000 - c_custkey END AS c_custkey, c_mktsegment FROM customer)"


def _ir_join(t: Tables, how: str) -> DataFrame:
    orders = t.orders.select("o_orderkey", F.expr("IF(o_orderstatus = 'P', -o_custkey, o_custkey) AS o_custkey"))
    cust = t.customer.select(
        F.expr("IF(c_acctbal > 2000, c_custkey, -1000000000 - c_custkey) AS c_custkey"), "c_mktsegment"
    )
    return joins.ir_join(orders, cust, "PREP.ORDERS.o_custkey", "DIM.CUSTOMER.c_custkey", how)


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL OUTER")):
    query(
        f"ir_join_{_how}",
        f"""
        SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment
        FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS o_custkey FROM orders)
        {_sql} JOIN {_CUST} ON o_custkey = c_custkey
        """,
    )(lambda t, how=_how: _ir_join(t, how))


@query(
    "semi_join_covered",
    "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT CASE WHEN quality = 1 THEN doc_id ELSE -1 - doc_id END FROM labels)",
)
def semi_join_covered(t: Tables) -> DataFrame:
    good = t.labels.select(F.expr("IF(quality = 1, doc_id, -1 - doc_id) AS doc_id"))
    return joins.covered_rows(t.documents, ["doc_id"], good, ["doc_id"]).select("doc_id", "lang")


@query(
    "anti_join_rows",
    """
    SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
    WHERE l_suppkey NOT IN (SELECT CASE WHEN s_nationkey < 20 THEN s_suppkey ELSE -s_suppkey END FROM supplier)
    """,
)
def anti_join_rows(t: Tables) -> DataFrame:
    parent = t.supplier.select(F.expr("IF(s_nationkey < 20, s_suppkey, -s_suppkey) AS s_suppkey"))
    return joins.orphan_rows(t.lineitem, ["l_suppkey"], parent, ["s_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_suppkey"
    )


@query(
    "key_compare",
    """
    WITH a AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_totalprice AS v FROM orders),
         b AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN -1000000000 - o_orderkey ELSE o_orderkey END AS o_orderkey,
                      CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_totalprice END AS v FROM orders)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
           CASE WHEN b.o_orderkey IS NULL THEN 'left' WHEN a.o_orderkey IS NULL THEN 'right'
                WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'differs' END AS side,
           a.v AS v_left, b.v AS v_right
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
    """,
)
def key_compare(t: Tables) -> DataFrame:
    a = t.orders.select(
        F.expr("IF(o_orderstatus = 'P', -o_orderkey, o_orderkey) AS o_orderkey"), F.col("o_totalprice").alias("v")
    )
    b = t.orders.select(
        F.expr("IF(o_orderpriority = '5-LOW', -1000000000 - o_orderkey, o_orderkey) AS o_orderkey"),
        F.expr("CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_totalprice END AS v")
    )
    return joins.key_compare(a, b, ["o_orderkey"], ["v"])


@query(
    "key_compare_repeated",
    """
    WITH a AS (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey END AS k, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL),
         b AS (SELECT CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linenumber = 3 THEN -l_suppkey ELSE l_suppkey END AS k,
                      CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN NULL ELSE l_quantity END AS v, count(*) AS n FROM lineitem GROUP BY ALL),
         m AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS l, coalesce(b.n, 0) AS r
               FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.v IS NOT DISTINCT FROM b.v),
         t AS (SELECT k, sum(least(l, r)) AS s, sum(l - least(l, r)) AS l, sum(r - least(l, r)) AS r FROM m GROUP BY k),
         o AS (SELECT k AS l_suppkey, unnest(['same', 'differs', 'left', 'right']) AS side,
                      unnest([s, least(l, r), l - least(l, r), r - least(l, r)]) AS n FROM t)
    SELECT l_suppkey, side, n::BIGINT AS n FROM o WHERE n > 0
    """,
)
def key_compare_repeated(t: Tables) -> DataFrame:
    """Half of all rows share the null key."""
    key = F.expr("IF(l_returnflag = 'N', NULL, l_suppkey) AS l_suppkey")
    a = t.lineitem.select(key, F.col("l_quantity").alias("v"))
    b = t.lineitem.select(
        F.expr("CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linenumber = 3 THEN -l_suppkey ELSE l_suppkey END AS l_suppkey"),
        F.expr("IF(l_linestatus = 'F' AND l_linenumber = 2, NULL, l_quantity) AS v"),
    )
    return joins.key_compare(a, b, ["l_suppkey"], ["v"]).groupBy("l_suppkey", "side").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ir_aggregate",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(l_quantity) AS avg_qty,
           min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def ir_aggregate_(t: Tables) -> DataFrame:
    return ir_aggregate(
        t.lineitem,
        {
            "n": ("count", "*"),
            "orders": ("count_distinct", "l_orderkey"),
            "revenue": ("sum", "l_extendedprice"),
            "avg_qty": ("avg", "l_quantity"),
            "first_ship": ("min", "l_shipdate"),
            "last_ship": ("max", "l_shipdate"),
        },
        ["l_returnflag", "l_linestatus"],
    )


@query(
    "sample_hash",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE CAST('0x' || substr(md5(concat_ws('|', '42', l_orderkey::VARCHAR, l_linenumber::VARCHAR)), 1, 15) AS BIGINT) % 1000000 < 50000
    """,
)
def sample_hash(t: Tables) -> DataFrame:
    sampled = auto_sample(t.lineitem, 20_000_000, 1_000_000, 42, by=["l_orderkey", "l_linenumber"])
    return sampled.select("l_orderkey", "l_linenumber", "l_partkey")
