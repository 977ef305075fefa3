"""Derived views over the driver tables.

The same SQL text runs in Spark (``spark.sql(text, events=df)``) and in DuckDB
(placeholders replaced by the registered table names), so the Spark queries and
their oracles read identical derived rows. Each view is a pure projection of a
base table: its size grows with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LOG_VIEW = """
SELECT event_id + 1 AS line_id, ts, CAST(ts AS DATE) AS date,
  'node-' || lpad(CAST(user_id % 50 AS VARCHAR(10)), 4, '0') AS node,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
  CASE event_id % 6 WHEN 0 THEN 'KERNEL' WHEN 1 THEN 'MEMORY' WHEN 2 THEN 'NETWORK' WHEN 3 THEN 'APP' WHEN 4 THEN 'IO' ELSE 'namenode' END AS component,
  CASE event_id * 31 % 11
    WHEN 0 THEN 'out of memory in rank ' || CAST(user_id AS VARCHAR(10))
    WHEN 1 THEN 'connection timeout to peer ' || CAST(event_id % 17 AS VARCHAR(10))
    WHEN 2 THEN 'login rejected: permission denied for user ' || CAST(user_id AS VARCHAR(10))
    WHEN 3 THEN 'cannot open file /data/part' || CAST(event_id % 23 AS VARCHAR(10))
    WHEN 4 THEN 'database commit took ' || CAST(event_id % 900 AS VARCHAR(10)) || ' ms'
    WHEN 5 THEN 'job ' || CAST(event_id % 40 AS VARCHAR(10)) || ' started on ' || CAST(user_id % 8 AS VARCHAR(10)) || ' nodes'
    WHEN 6 THEN 'job ' || CAST(event_id % 40 AS VARCHAR(10)) || ' finished'
    WHEN 7 THEN 'heartbeat received'
    WHEN 8 THEN 'unhandled exception in scheduler step ' || CAST(event_id % 13 AS VARCHAR(10))
    WHEN 9 THEN 'temperature threshold exceeded at rack ' || CAST(user_id % 12 AS VARCHAR(10))
    ELSE 'barrier reached' END AS message,
  (event_id * 7919 % 1000) / 1e3 AS anomaly_score,
  CASE WHEN event_id % 10 < 7 THEN '-' ELSE upper(event_type) END AS label
FROM {events}
"""

RAW_VIEW = """
SELECT source_file,
  CAST(event_id + 1 AS BIGINT) AS line_no,
  CASE WHEN event_id % 4 = 0 THEN '    at frame ' || CAST(event_id % 9 AS VARCHAR(10))
       ELSE lpad(CAST(event_id % 24 AS VARCHAR(10)), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR(10)), 2, '0') || ':'
            || lpad(CAST(event_id * 7 % 60 AS VARCHAR(10)), 2, '0') || '.' || lpad(CAST(event_id * 13 % 1000 AS VARCHAR(10)), 3, '0')
            || ' [worker-' || CAST(user_id % 5 AS VARCHAR(10)) || ']  req' || CAST(event_id AS VARCHAR(10))
            || ' DEBUG svc.Handler <init> - path = /v1/item/' || CAST(event_id % 30 AS VARCHAR(10)) END AS value,
  (event_id * 7919 % 1000) / 1e3 AS anomaly_score
FROM (SELECT *, CASE user_id % 4
        WHEN 0 THEN 'TOKEN_access_token_auth_header_error_401.log.parquet'
        WHEN 1 THEN 'TOKEN_correct.log'
        WHEN 2 THEN 'TOKEN_delete_user_404_no_user.log'
        ELSE 'plain.log' END AS source_file FROM {events}) e
"""

VECTOR_VIEW = """
SELECT vec_id + 1 AS line_id, embedding, vec_id % 25 = 7 AS anomaly
FROM {embeddings}
"""

EVAL_VIEW = """
SELECT event_id + 1 AS line_id,
  CASE event_id % 7 WHEN 0 THEN 'application' WHEN 1 THEN 'authentication' WHEN 2 THEN 'io' WHEN 3 THEN 'memory' WHEN 4 THEN 'network' WHEN 5 THEN 'device' ELSE 'other' END AS label,
  CASE WHEN event_id % 50 = 0 THEN NULL
       WHEN event_id % 5 = 0 THEN 'other'
       ELSE CASE event_id % 7 WHEN 0 THEN 'application' WHEN 1 THEN 'authentication' WHEN 2 THEN 'io' WHEN 3 THEN 'memory' WHEN 4 THEN 'network' WHEN 5 THEN 'other' ELSE 'other' END
  END AS anomaly_result,
  (event_id * 7919 % 1000) / 1e3 AS anomaly_score
FROM {events}
"""

RESPONSE_VIEW = """
SELECT event_id + 1 AS line_id,
  CASE event_id % 8
    WHEN 0 THEN ' Network ' WHEN 1 THEN 'a network connection issue' WHEN 2 THEN 'Authentication' WHEN 3 THEN 'API Error: 429'
    WHEN 4 THEN 'Error: refused' WHEN 5 THEN 'unknown region' WHEN 6 THEN 'memory' ELSE '' END AS response
FROM {events}
"""

# Lines with both a message and (for the first rows) a vector: the hybrid view.
HYBRID_VIEW = """
SELECT l.line_id, l.message, v.embedding, l.anomaly_score >= 0.8 AS anomaly
FROM ({log_view}) l LEFT JOIN {embeddings} v ON v.vec_id + 1 = l.line_id
"""

VIEWS = {
    "log_view": LOG_VIEW,
    "raw_view": RAW_VIEW,
    "vector_view": VECTOR_VIEW,
    "eval_view": EVAL_VIEW,
    "response_view": RESPONSE_VIEW,
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (SRC1 on a single path)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tables_in(sql: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy Spark DataFrame."""
    if name == "hybrid_view":
        return spark.sql(
            HYBRID_VIEW.replace("{log_view}", LOG_VIEW),
            events=table(spark, sf_dir, "events"),
            embeddings=table(spark, sf_dir, "embeddings"),
        )
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _tables_in(sql)})


def duck_view(name: str) -> str:
    """The view body for the DuckDB oracle (tables are pre-registered by name)."""
    if name == "hybrid_view":
        sql = HYBRID_VIEW.replace("{log_view}", LOG_VIEW)
    else:
        sql = VIEWS[name]
    return _PLACEHOLDER.sub(lambda m: m.group(1), sql)


def with_views(body: str, *names: str, extra: str = "") -> str:
    """Prefix an oracle query with ``WITH name AS (view), ...`` and further CTEs."""
    ctes = [f"{n} AS ({duck_view(n)})" for n in names]
    if extra.strip():
        ctes.append(extra.strip().strip(","))
    return "WITH " + ",\n".join(ctes) + "\n" + body
