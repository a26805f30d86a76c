"""The data model's tables over the driver's; the same text runs in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REVIEWS = """
SELECT source AS shop_key, doc_id AS review_id, 'user' || CAST(doc_id % 97 AS STRING) AS author,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(1 + doc_id % 5 AS DOUBLE) END AS stars, text,
  CASE WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 29 = 0 THEN 'https://p/x' || CAST(doc_id % 97 AS STRING)
    ELSE 'https://p/' || CAST(doc_id % 97 AS STRING) END AS profile_url,
  doc_id AS first_seen_seq, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id * doc_id % 365 END AS posted_day
FROM documents
"""
OBSERVATIONS = """
SELECT user_id AS review_key, event_id AS seq, ts AS observed_at, CAST(1 + event_id % 9 AS STRING) ||
  CASE event_type WHEN 'click' THEN ' minutes ago' WHEN 'view' THEN ' days ago' WHEN 'purchase' THEN ' weeks ago'
    WHEN 'signup' THEN ' months ago' ELSE ' unknown' END AS time_text
FROM events
"""
FRAGMENTS = """
SELECT conv_id AS id, turn AS ord, CASE WHEN role = 'user' THEN text ELSE '' END AS review_text,
  CASE WHEN role = 'assistant' THEN text ELSE '' END AS reply_text
FROM conversations
"""
PARTS = """
SELECT l_orderkey AS event_id, l_linenumber AS part_no, CASE WHEN l_returnflag = 'R' THEN 'sent' ELSE 'pending' END AS status,
  CAST(l_quantity AS INT) % 10 AS attempts, l_shipdate AS next_attempt_at
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    name = sql.rsplit("FROM", 1)[1].strip()
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, REVIEWS)
