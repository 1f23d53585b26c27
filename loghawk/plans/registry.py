"""Query catalogue: name -> Spark query, and name -> DuckDB oracle SQL.

Every query reads the provided tables (or the ``api_log`` view Spark
derives from ``events``) in full.  ``finish`` puts results in a form two
engines can agree on: doubles rounded to 6 digits by way of a decimal of 9
(inputs have two decimals, so means often sit halfway between two 6-digit
values, where the noise of a sum would decide; the decimal takes it away),
timestamps as text to the microsecond.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk.functions.columns import ZERO_SCALE
from loghawk.sources.tables import API_LOG_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.try_cast("decimal(38,9)"), 6).cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql_finish(inner: str, doubles: list[str] = (), times: list[str] = (), others: list[str] = ()) -> str:
    """Wrap an oracle SELECT the same way ``finish`` wraps the Spark result."""
    cols = ([f'"{c}"' for c in others] + [f'CAST(ROUND(TRY_CAST("{c}" AS DECIMAL(38, 9)), 6) AS DOUBLE) AS "{c}"' for c in doubles]
            + [f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{c}\"" for c in times])
    return f"SELECT {', '.join(cols)} FROM ({inner}) AS q"


def with_log(rest: str) -> str:
    """Prefix the ``api_log`` CTE; ``rest`` is ``', more AS (...) SELECT ...'`` or ``' SELECT ...'``."""
    return f"WITH api_log AS ({API_LOG_SQL})" + rest


# ---- DuckDB fragments shared by the log queries --------------------------------
# The octet and address patterns of ``functions.columns``.
OCT1 = r"(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}"
OCT2 = r"\d{1,3}\.(\d{1,3})\.\d{1,3}\.\d{1,3}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"

SQL_FEATURE_EXPRS = {
    "request_time_hour": "CAST(hour(request_time) AS INTEGER)",
    "request_time_day": "CAST(day(request_time) AS INTEGER)",
    "request_time_dayofweek": "CAST(isodow(request_time) - 1 AS INTEGER)",
    "ip_address_first_octet": f"TRY_CAST(NULLIF(regexp_extract(ip_address, '{OCT1}', 1), '') AS DOUBLE)",
    "ip_address_second_octet": f"TRY_CAST(NULLIF(regexp_extract(ip_address, '{OCT2}', 1), '') AS DOUBLE)",
    "user_agent_is_mobile": "COALESCE(CAST(regexp_matches(user_agent, '(?i)Mobile|Android|iOS') AS INTEGER), 0)",
    "user_agent_is_chrome": "COALESCE(CAST(regexp_matches(user_agent, '(?i)Chrome') AS INTEGER), 0)",
    "user_agent_is_firefox": "COALESCE(CAST(regexp_matches(user_agent, '(?i)Firefox') AS INTEGER), 0)",
    "user_agent_is_safari": "COALESCE(CAST(regexp_matches(user_agent, '(?i)Safari') AS INTEGER), 0)",
    "status_code_is_success": "COALESCE(CAST(status_code >= 200 AND status_code < 300 AS INTEGER), 0)",
    "status_code_is_redirect": "COALESCE(CAST(status_code >= 300 AND status_code < 400 AS INTEGER), 0)",
    "status_code_is_client_error": "COALESCE(CAST(status_code >= 400 AND status_code < 500 AS INTEGER), 0)",
    "status_code_is_server_error": "COALESCE(CAST(status_code >= 500 AS INTEGER), 0)",
}
SQL_BUCKET5 = "time_bucket(INTERVAL '5 minutes', request_time)"

# f: every derived scalar feature plus requests_per_ip, joined back by IP.
SQL_FEATURES_CTE = (
    ", f0 AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in SQL_FEATURE_EXPRS.items()) + " FROM api_log)"
    ", ipc AS (SELECT ip_address, count(*) AS requests_per_ip FROM api_log WHERE ip_address IS NOT NULL GROUP BY ip_address)"
    ", f AS (SELECT f0.*, ipc.requests_per_ip FROM f0 LEFT JOIN ipc ON f0.ip_address = ipc.ip_address)"
)


def sql_zscore_ctes(features: list[str]) -> str:
    """CTEs f1 (filled), s (one-row mean/std), z (scored log with error),
    t (one-row threshold) after SQL_FEATURES_CTE."""
    fill = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in features)
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in features)
    zs = " + ".join(f"(CASE WHEN s_{c} IS NULL OR s_{c} <= {ZERO_SCALE!r} THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END) ^ 2"
                    for c in features)
    return (f", f1 AS (SELECT log_id, ip_address, request_time, status_code, {fill} FROM f)"
            f", s AS (SELECT {stats} FROM f1)"
            f", z AS (SELECT log_id, ip_address, request_time, status_code, ({zs}) / {float(len(features))} AS reconstruction_error FROM f1, s)"
            ", t AS (SELECT avg(reconstruction_error) + 3 * stddev_pop(reconstruction_error) AS threshold FROM z)"
            ", scored AS (SELECT z.*, reconstruction_error > threshold AS is_anomaly,"
            " reconstruction_error / threshold AS anomaly_score FROM z, t)")
