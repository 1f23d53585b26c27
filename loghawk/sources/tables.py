"""Provided Parquet tables and the ``api_log`` view derived from ``events``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed values of the api_log view (user-agent strings per user_id % 6; 5 gives NULL).
API_LOG_USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.124 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:89.0) Gecko/20100101 Firefox/89.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 14_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/14.0 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 11; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/91.0.4472.120 Mobile Safari/537.36",
    "curl/7.64.1",
]

API_LOG_COLUMNS = ["log_id", "ip_address", "request_time", "user_agent", "endpoint", "method",
                   "parameters", "status_code", "response_ms"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def api_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The API access log used by every log operator: a narrow projection of
    ``events`` (no shuffle), one log row per event."""
    return events_to_api_log(read_table(spark, sf_dir, "events"))


def events_to_api_log(ev: DataFrame) -> DataFrame:
    """The projection behind ``api_log``; works on a batch or a streaming ``events``."""
    uid = F.col("user_id")
    ua = F.lit(None).cast("string")
    for i in reversed(range(len(API_LOG_USER_AGENTS))):
        ua = F.when(uid % 6 == i, F.lit(API_LOG_USER_AGENTS[i])).otherwise(ua)
    et = F.col("event_type")
    status = (F.when(et == "signup", 201).when(et == "click", 302)
              .when(et == "error", F.when(F.col("event_id") % 3 == 0, 500).otherwise(404))
              .otherwise(200)).cast("int")
    return ev.select(
        F.col("event_id").alias("log_id"),
        F.concat(F.lit("10."), (uid % 16).cast("string"), F.lit(".0."), (uid % 250).cast("string")).alias("ip_address"),
        F.col("ts").alias("request_time"),
        ua.alias("user_agent"),
        F.concat(F.lit("/api/"), et).alias("endpoint"),
        F.when(et.isin("view", "click"), "GET").otherwise("POST").alias("method"),
        F.col("props").alias("parameters"),
        status.alias("status_code"),
        F.col("value").alias("response_ms"),
    )


# The same view in DuckDB SQL, used by the oracle queries.
_AGENT_SQL = "\n".join(f"    WHEN {i} THEN '{agent}'" for i, agent in enumerate(API_LOG_USER_AGENTS))
API_LOG_SQL = """
SELECT event_id AS log_id,
  concat('10.', CAST(user_id % 16 AS VARCHAR), '.0.', CAST(user_id % 250 AS VARCHAR)) AS ip_address,
  ts AS request_time,
  CASE user_id % 6
{agents}
    ELSE NULL END AS user_agent,
  concat('/api/', event_type) AS endpoint,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'GET' ELSE 'POST' END AS method,
  props AS parameters,
  CAST(CASE event_type WHEN 'signup' THEN 201 WHEN 'click' THEN 302
    WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 500 ELSE 404 END ELSE 200 END AS INTEGER) AS status_code,
  value AS response_ms
FROM events
""".replace("{agents}", _AGENT_SQL)
