"""Personal data in documents, pages, conversations and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablecheck.functions import privacy as P
from tablecheck.operators import privacy as R

from .base import Tables, query, verdict


def _re(kind: str) -> str:
    return "'" + P.VALUE_PATTERNS[kind] + "'"


def _scan_sql(table: str, column: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", '{k}' AS kind, CAST(coalesce(sum(len(regexp_extract_all({column}, {_re(k)}))), 0) AS BIGINT) AS matches, "
        f"count(*) FILTER (regexp_matches({column}, {_re(k)})) AS rows_affected FROM {table}"
        for k in P.VALUE_PATTERNS
    )


for _table, _column in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
    query(f"pii_scan_{_table}", _scan_sql(_table, _column))(
        lambda t, table=_table, column=_column: R.pii_scan(getattr(t, table), [column])
    )


def _redact_sql(c: str) -> str:
    out = c
    for k in reversed(list(P.VALUE_PATTERNS)):
        out = f"CASE WHEN regexp_matches({c}, {_re(k)}) THEN regexp_replace({c}, {_re(k)}, '{P.placeholder(k)}', 'g') ELSE {out} END"
    return out


def _text_sql(c: str) -> str:
    for k in P.VALUE_PATTERNS:
        c = f"regexp_replace({c}, {_re(k)}, '{P.placeholder(k)}', 'g')"
    return c


@query("redact_documents", f"SELECT doc_id, {_redact_sql('text')} AS text, {_redact_sql('lang')} AS lang FROM documents")
def redact_documents(t: Tables) -> DataFrame:
    return R.redact(t.documents.select("doc_id", "text", "lang"))


@query("redact_nested", f"SELECT doc_id, {_redact_sql('text')} AS inner_text, {_redact_sql('text')} AS item, {_redact_sql('lang')} AS value FROM documents")
def redact_nested(t: Tables) -> DataFrame:
    nested = t.documents.select(
        "doc_id",
        F.struct(F.col("text").alias("body")).alias("wrapped"),
        F.array("text").alias("items"),
        F.create_map(F.lit("k"), F.col("lang")).alias("entries"),
    )
    return R.redact(nested).select(
        "doc_id",
        F.col("wrapped.body").alias("inner_text"),
        F.col("items")[0].alias("item"),
        F.col("entries")["k"].alias("value"),
    )


@query("redact_text", f"SELECT page_id, {_text_sql('html')} AS html FROM pages")
def redact_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", P.redact_text(F.col("html")).alias("html"))


@query(
    "redact_conversations",
    f"SELECT conv_id, turn, {_text_sql('text')} AS text FROM conversations",
)
def redact_conversations(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", P.redact_text(F.col("text")).alias("text"))


def _mask_sql(c: str) -> str:
    return (
        f"CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) "
        f"WHEN length({c}) <= 8 THEN substr({c}, 1, 2) || repeat('*', length({c}) - 4) || substr({c}, length({c}) - 1) "
        f"ELSE substr({c}, 1, 3) || repeat('*', length({c}) - 6) || substr({c}, length({c}) - 2) END"
    )


@query(
    "mask_names",
    f"SELECT p_partkey, {_mask_sql('p_name')} AS p_name, {_redact_sql('p_brand')} AS p_brand, {_redact_sql('p_type')} AS p_type, p_retailprice FROM part",
)
def mask_names(t: Tables) -> DataFrame:
    return R.redact(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"))


@query(
    "mask_short_values",
    f"SELECT o_orderkey, {_mask_sql('phone')} AS phone FROM (SELECT o_orderkey, substr(CAST(o_orderkey AS VARCHAR) || '555-0100', 1, 1 + CAST(o_orderkey % 12 AS INTEGER)) AS phone FROM orders)",
)
def mask_short_values(t: Tables) -> DataFrame:
    return R.redact(
        t.orders.select(
            "o_orderkey",
            F.expr(
                "substr(CAST(o_orderkey AS STRING) || '555-0100', 1, 1 + CAST(o_orderkey % 12 AS INT)) AS phone"
            ),
        )
    )


@query(
    "redact_hash",
    "SELECT c_custkey, sha256(c_name) AS c_name, c_acctbal FROM customer",
)
def redact_hash(t: Tables) -> DataFrame:
    return R.redact(t.customer.select("c_custkey", "c_name", "c_acctbal"), "hash")


@query(
    "redact_last4",
    "SELECT s_suppkey, CASE WHEN length(s_name) <= 4 THEN repeat('*', length(s_name)) ELSE repeat('*', length(s_name) - 4) || right(s_name, 4) END AS s_name FROM supplier",
)
def redact_last4(t: Tables) -> DataFrame:
    return R.redact(t.supplier.select("s_suppkey", "s_name"), "last4")


@query(
    "redact_email_strategy",
    "SELECT c_custkey, substr(email, 1, 1) || '***' || '@example.com' AS email FROM (SELECT c_custkey, replace(lower(c_name), '#', '.') || '@example.com' AS email FROM customer)",
)
def redact_email_strategy(t: Tables) -> DataFrame:
    c = t.customer.select(
        "c_custkey", F.expr("replace(lower(c_name), '#', '.') || '@example.com' AS email")
    )
    return R.redact(c, "email")


@query(
    "check_no_pii",
    """
    SELECT 'fail' AS status, CAST(2 AS BIGINT) AS violations, 'warn' AS gate, 'c_name' AS exposed_columns, 'true' AS all_columns, count(*) AS total_rows FROM customer
    """,
)
def check_no_pii(t: Tables) -> DataFrame:
    r = R.check_no_pii(t.customer, t.customer)
    return verdict(r, "gate", exposed_columns="string", all_columns="string", total_rows="bigint")


def _any_pii(c: str) -> str:
    return " OR ".join(f"regexp_matches({c}, {_re(k)})" for k in P.VALUE_PATTERNS)


@query(
    "check_no_pii_values",
    f"""
    SELECT CASE WHEN count(*) FILTER ({_any_pii("text")}) > 0 THEN 'fail' ELSE 'pass' END AS status,
           count(*) FILTER ({_any_pii("text")}) AS violations, '' AS exposed_columns, count(*) AS total_rows FROM documents
    """,
)
def check_no_pii_values(t: Tables) -> DataFrame:
    r = R.check_no_pii(t.documents.select("doc_id", "text"), values=True)
    return verdict(r, exposed_columns="string", total_rows="bigint")


@query("pii_rows", f"SELECT doc_id, source FROM documents WHERE {_any_pii('text')}")
def pii_rows(t: Tables) -> DataFrame:
    return R.pii_rows(t.documents, ["text"]).select("doc_id", "source")
