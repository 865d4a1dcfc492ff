"""Inputs that queries derive from the driver's tables, as SQL that Spark and DuckDB read alike.

Each is a SELECT over tables whose names stand in braces: Spark gets parquet paths, DuckDB the views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TAG = "'77-' || lpad(CAST({k} % 1000 AS STRING), 3, '0') || '-A' || lpad(CAST({k} AS STRING), 6, '0') || '-' || lpad(CAST({k} % 100 AS STRING), 2, '0')"
_TAG2 = "'77-' || lpad(CAST({k} % 1000 AS STRING), 3, '0') || '-B' || lpad(CAST({k} AS STRING), 6, '0')"
_K = "(o_custkey * 7 + o_orderkey) % 2000 + 1"


def tag(k: str) -> str:
    return _TAG.replace("{k}", f"({k})")


def tag2(k: str) -> str:
    return _TAG2.replace("{k}", f"({k})")


CORPUS = f"""
    SELECT o_orderkey AS unit_id, 'Ref ' || CASE o_orderkey % 6 WHEN 0 THEN ':' WHEN 1 THEN '(' WHEN 2 THEN '1' WHEN 3 THEN '11' WHEN 4 THEN 'é' ELSE '' END
           || CASE WHEN o_orderkey % 5 = 0 THEN {tag2(_K)} ELSE {tag(_K)} END || ') qty ' || CAST(o_custkey AS STRING)
           || CASE WHEN o_orderkey % 3 = 0 THEN ' alt ' || {tag("(o_orderkey * 3) % 2000 + 1")} ELSE '' END AS text
    FROM {{orders}}"""

MAPPING = f"""
    SELECT CAST(p_partkey AS INT) AS ord, CASE p_partkey % 5 WHEN 2 THEN lower({tag("p_partkey")}) WHEN 3 THEN replace({tag("p_partkey")}, '-', '') ELSE {tag("p_partkey")} END AS key,
           '4022-' || lpad(CAST((p_partkey * 7) % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(p_partkey AS STRING), 6, '0') AS value
    FROM {{part}} WHERE p_partkey % 5 <> 0"""

#: Integer boxes, two engines for each image.
BOXES = """
    SELECT CAST(p_partkey / 20 AS INT) AS image_id, 'easyocr' AS engine, CAST(p_partkey AS INT) AS ord, CAST((p_partkey * 37) % 400 AS INT) AS x, CAST((p_partkey * 53) % 120 AS INT) AS y,
           CAST(40 + p_partkey % 60 AS INT) AS w, CAST(12 + p_partkey % 9 AS INT) AS h, CAST((p_partkey * 17) % 100 AS DOUBLE) / 100 AS confidence, p_name AS text FROM {part}
    UNION ALL
    SELECT CAST(p_partkey / 20 AS INT), 'tesseract', CAST(p_partkey AS INT), CAST((p_partkey * 37) % 400 + (p_partkey % 7) * 3 AS INT), CAST((p_partkey * 53) % 120 + (p_partkey % 3) * 2 AS INT),
           CAST(40 + p_partkey % 60 + p_partkey % 5 AS INT), CAST(12 + p_partkey % 9 AS INT), CAST((p_partkey * 29) % 100 AS DOUBLE) / 100, upper(p_name) FROM {part}""".replace("p_partkey / 20", "floor(p_partkey / 20)")

TEXTBOXES = f"""
    SELECT p_partkey AS box_id, CAST(60 + (p_partkey * 7) % 200 AS DOUBLE) + 0.5 AS width, CAST(10 + (p_partkey * 3) % 60 AS DOUBLE) + 0.25 AS height,
           CASE p_partkey % 4 WHEN 0 THEN 'Arial' WHEN 1 THEN 'times new roman' WHEN 2 THEN 'PMingLiU' ELSE 'Other' END AS family,
           CAST(8 + p_partkey % 9 AS DOUBLE) * 0.5 + 4 AS size, p_partkey % 11 <> 0 AS has_dimensions, p_name || ' ' || {tag("p_partkey")} AS text
    FROM {{part}}"""

#: Processing results, one for each event.
RESULTS = """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '.doc' ELSE '.docx' END AS doc_type, event_type AS processor, CAST(user_id % 50 AS INT) AS batch, event_id % 13 <> 0 AS success,
           CAST(event_id % 61 AS INT) AS matches, CAST((event_id * 31) % 5000 AS INT) AS millis, CAST(1000 + (event_id * 97) % 90000 AS INT) AS size_before, CAST(1000 + (event_id * 89) % 99000 AS INT) AS size_after,
           CAST(200 + (event_id * 41) % 900 AS INT) AS memory_mb, CAST((event_id * 7) % 100 AS INT) AS cpu
    FROM {events}"""

FILES = """
    SELECT c_custkey AS file_id, CASE c_custkey % 9 WHEN 0 THEN '~' WHEN 1 THEN '.' ELSE '' END || CASE WHEN c_custkey % 17 = 0 THEN 'a:b' ELSE '' END || 'file' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)
           || CASE WHEN c_custkey % 10 = 0 THEN '_12NC_processed' ELSE '' END AS stem,
           CASE c_custkey % 7 WHEN 0 THEN '.doc' WHEN 1 THEN '.txt' ELSE '.docx' END AS ext, CASE WHEN c_custkey % 23 = 0 THEN '/in/processed' ELSE '/in' END AS parent,
           CAST((c_custkey * 7919) % 400 AS BIGINT) * 1048576 AS length, CASE WHEN c_custkey % 19 = 0 THEN 'PK00' ELSE 'PK34' END AS magic
    FROM {customer}"""


#: Styled runs, a text unit for each customer.
RUNS = """
    SELECT o_custkey AS unit_id, o_orderkey AS run_idx, 'order ' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 4 = 1 THEN ' of customer ' || CAST(o_custkey AS STRING) ELSE '' END AS text,
           CASE o_orderkey % 4 WHEN 1 THEN 'Arial' WHEN 2 THEN 'Times New Roman' WHEN 3 THEN 'PMingLiU' END AS family,
           CASE o_orderkey % 3 WHEN 1 THEN CAST(12 AS DOUBLE) WHEN 2 THEN CAST(8 AS DOUBLE) + CAST(o_orderkey % 9 AS DOUBLE) / 2 END AS size FROM {orders}"""

#: Texts as an archive can hold them. Spark's SQL reads a doubled backslash as one, DuckDB's reads them as they are.
ARCHIVED = "SELECT CAST(doc_id AS STRING) AS path, regexp_replace(coalesce(text, ''), '[{b}x00-{b}x08{b}x0B-{b}x1F]', ' '{g}) AS text FROM {{documents}}"


#: JSON text of each event, of three shapes and up to five levels.
METADATA = """
    SELECT event_id, '{"type":"' || event_type || '","user":{"id":' || CAST(user_id AS STRING) || ',"note":null,"tags":[' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '"a","b {[c"' END || ']},'
           || CASE event_id % 4 WHEN 0 THEN '"empty":{}' WHEN 1 THEN '"deep":{"a":[{"b":[1,true]},2]}' WHEN 2 THEN '"list":[null,"x",{"y":false}]' ELSE '"odd key":"q"' END || '}' AS metadata
    FROM {events}"""


def spark(session: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The input as a DataFrame; tables are read by Spark from ``sf_dir``."""
    return session.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def duck(sql: str) -> str:
    """The input as a DuckDB subquery over the registered views."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"
