"""The driver's tables in the shape of page entries, logs and calls, and the same in SQL for the oracle.

Each shape is SQL that Spark and DuckDB read alike; queries apply the operators to it, and oracles are written on
it by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagegraph.session import table

#: Order lines as page entries: a customer is a file, an order a document, a line an entry.
ENTRIES = """
SELECT CAST(o.o_custkey AS BIGINT) AS file_id,
       CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax) AS INT) AS entry_seq,
       CAST(sum(CASE WHEN l.l_partkey % 5 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS INT) AS page_number,
       CAST(l.l_linenumber AS INT) AS marker_index,
       CAST(count(*) OVER (PARTITION BY l.l_orderkey) AS INT) AS marker_total,
       l.l_linenumber = 1 AS starts_new,
       l.l_partkey % 7 NOT IN (0, 2) AS include,
       CASE l.l_partkey % 7 WHEN 0 THEN 'admin' WHEN 1 THEN 'signature_only' WHEN 2 THEN 'empty' WHEN 3 THEN 'imaging' ELSE 'clinical' END AS kind,
       CASE l.l_returnflag WHEN 'R' THEN 'clinical' WHEN 'A' THEN 'imaging' ELSE 'unknown' END AS bucket,
       CASE WHEN l.l_partkey % 3 = 0 THEN 'Report ' || CAST(l.l_partkey % 5 AS STRING) END AS title,
       CASE WHEN l.l_suppkey % 6 <> 0 THEN CAST(CAST(l.l_shipdate AS DATE) AS STRING) END AS date,
       CASE WHEN l.l_suppkey % 4 <> 0 THEN 'Supplier ' || CAST(l.l_suppkey % 10 AS STRING) || 'x' END AS author,
       CASE WHEN l.l_partkey % 9 = 0 THEN 'Copied ' || CAST(l.l_suppkey % 3 AS STRING) || 'y' END AS recipient,
       CAST(NULL AS STRING) AS custom_type,
       CASE WHEN l.l_partkey % 6 = 0 THEN 'Person ' || CAST(l.l_orderkey % 3 AS STRING) || 'z' END AS patient_name,
       CASE WHEN l.l_partkey % 12 = 0 THEN '1970-01-0' || CAST(l.l_orderkey % 3 + 1 AS STRING) END AS patient_dob,
       CASE WHEN l.l_partkey % 10 = 0 THEN 'id' || CAST(l.l_orderkey % 2 AS STRING) END AS patient_identifier,
       CAST(floor(l.l_quantity / 10) AS INT) AS n_evidence,
       CAST(l.l_orderkey AS BIGINT) AS order_key,
       CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS order_date
FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey"""

#: Orders as documents of their customer, dated and with what their lines add up to.
DOCUMENTS = """
SELECT CAST(o.o_custkey AS BIGINT) AS file_id, CAST(o.o_orderkey AS BIGINT) AS doc_pos,
       CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS iso,
       CASE o.o_orderstatus WHEN 'F' THEN 'clinical' WHEN 'O' THEN 'imaging' ELSE 'unknown' END AS bucket,
       CASE WHEN o.o_orderkey % 5 <> 0 THEN o.o_orderpriority END AS author,
       o.o_orderkey % 11 <> 0 AS include, o.o_orderkey % 13 = 0 AS claimant_authored,
       CASE WHEN o.o_orderkey % 17 <> 0 THEN CAST(o.o_orderkey % 4 AS INT) END AS sole_page,
       CAST(o.o_orderkey % 9 AS INT) AS n_evidence
FROM {orders} o"""

#: Events as calls of models.
CALLS = """
SELECT event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'openai' ELSE 'gemini' END AS provider,
       CASE event_id % 7 WHEN 0 THEN 'gpt-4.1' WHEN 1 THEN 'GPT-4.1-mini-2025' WHEN 2 THEN 'gpt-5.4' WHEN 3 THEN 'gemini-2.5-flash-lite' WHEN 4 THEN 'gemini-2.5-flash-002' WHEN 5 THEN 'o3-mini' ELSE 'unlisted' END AS model,
       CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens, CAST(floor(value * 100) AS BIGINT) % 50 AS cached_tokens,
       CAST(user_id AS BIGINT) AS file_id, ts, CAST(event_id AS BIGINT) AS event_id
FROM {events}"""

#: Order dates in the ways that records write them.
RAW_DATES = """
SELECT CAST(o_orderkey AS BIGINT) AS doc_pos, CAST(o_custkey AS BIGINT) AS file_id, CAST(o_orderkey % 6 AS INT) AS style, CAST(o_orderdate AS DATE) AS day
FROM {orders}"""

_SHAPES = {"entries": ENTRIES, "documents_of_orders": DOCUMENTS, "calls": CALLS, "raw_dates": RAW_DATES}
_TABLES = ("orders", "lineitem", "events")


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shape as a DataFrame."""
    sql = _SHAPES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql})


def shape_sql(name: str) -> str:
    """A shape as SQL on the driver's views."""
    return _SHAPES[name].format(**{t: t for t in _TABLES})
