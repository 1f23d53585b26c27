"""Registered source/sink queries: CSV log scan, mapped-log,
report and feedback sinks.  Each writes the derived log to the checkpoint
folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loghawk.operators import detect as DT
from loghawk.plans.preprocess import zscore_scored
from loghawk.plans.catalog_log import ZS
from loghawk.plans.registry import SQL_FEATURES_CTE, finish, register, sql_finish, with_log
from loghawk.session import cut_lineage, scratch_path
from loghawk.sources.logs import RAW_LOG_SCHEMA, RFC_4180, read_feedback, read_logs, write_feedback, write_logs, write_report
from loghawk.sources.tables import api_log


def _raw_csv(spark, sf) -> str:
    """The api_log in the raw CSV layout of an uploaded access log."""
    log = api_log(spark, sf)
    raw = log.select("ip_address", F.date_format("request_time", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                     "user_agent", "endpoint", "method", "parameters", "status_code",
                     F.round("response_ms").cast("long").alias("response_time_ms"))
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:8]}")
    write_logs(raw, path, fmt="csv")
    return path


_CSV_SQL = with_log(
    " SELECT endpoint, count(*) AS requests, CAST(sum(CAST(round(response_ms) AS BIGINT)) AS BIGINT) AS total_response_time_ms,"
    " count(*) FILTER (WHERE user_agent IS NULL) AS null_agents, CAST(min(hour(request_time)) AS INTEGER) AS first_hour"
    " FROM api_log GROUP BY endpoint")


def _csv_summary(df):
    return df.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("response_time_ms").cast("long").alias("total_response_time_ms"),
        F.count_if(F.col("user_agent").isNull()).alias("null_agents"),
        F.min(F.hour(F.col("timestamp").cast("timestamp"))).alias("first_hour"))


FEEDBACK_SQL = sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + ", fb AS (SELECT log_id, status_code >= 400 AS is_true_anomaly FROM scored WHERE is_anomaly)"
    " SELECT count(*) FILTER (WHERE is_true_anomaly) AS true_positives,"
    " count(*) FILTER (WHERE NOT is_true_anomaly) AS false_positives,"
    " CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_true_anomaly) / count(*) ELSE 0.0 END AS precision FROM fb"),
    doubles=["precision"], others=["true_positives", "false_positives"])


@register("io_csv_scan_with_schema", _CSV_SQL)
def q_csv_schema(spark, sf):
    """Write the log as CSV, scan it back with an explicit schema (PERMISSIVE)."""
    df = read_logs(spark, _raw_csv(spark, sf), RAW_LOG_SCHEMA)
    return _csv_summary(df)


@register("io_csv_scan_inferred", _CSV_SQL)
def q_csv_inferred(spark, sf):
    """The same scan with inferred types (the upload path of the reference)."""
    df = read_logs(spark, _raw_csv(spark, sf))
    return _csv_summary(df)


@register("io_csv_quoted", with_log(
    """ SELECT log_id, '{"id": ' || log_id || ', "name": "' || endpoint || '"}' AS parameters, CAST(log_id AS VARCHAR) AS id, endpoint AS name,
    'say "' || method || '", twice' AS note, status_code, mode FROM api_log, (VALUES ('schema'), ('ddl'), ('inferred')) AS m(mode)"""))
def q_csv_quoted(spark, sf):
    """JSON and quotes in values, written with doubled quotes and read back in all three schema modes."""
    log = api_log(spark, sf)
    raw = log.select("log_id", F.concat(F.lit('{"id": '), F.col("log_id").cast("string"), F.lit(', "name": "'), "endpoint", F.lit('"}')).alias("parameters"),
                     F.concat(F.lit('say "'), "method", F.lit('", twice')).alias("note"), "status_code")
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:8]}")
    write_logs(raw, path, fmt="csv")
    out = None
    for mode, schema in (("schema", raw.schema), ("ddl", "log_id long, parameters string, note string, status_code int"), ("inferred", None)):
        df = read_logs(spark, path, schema).where(F.col("_corrupt_record").isNull())
        df = df.select(F.col("log_id").cast("long").alias("log_id"), "parameters", F.get_json_object("parameters", "$.id").alias("id"),
                       F.get_json_object("parameters", "$.name").alias("name"), "note", "status_code", F.lit(mode).alias("mode"))
        out = df if out is None else out.union(df)
    return out


@register("io_report_sink", with_log(
    SQL_FEATURES_CTE + ZS + " SELECT CAST(log_id AS VARCHAR) AS log_id, ip_address,"
    " strftime(request_time, '%Y-%m-%d %H:%M:%S.%f') AS request_time, CAST(status_code AS VARCHAR) AS status_code,"
    " CAST(CAST(ROUND(TRY_CAST(reconstruction_error AS DECIMAL(38, 9)), 6) AS DOUBLE) AS VARCHAR) AS reconstruction_error,"
    " CAST(is_anomaly AS VARCHAR) AS is_anomaly,"
    " CAST(CAST(ROUND(TRY_CAST(anomaly_score AS DECIMAL(38, 9)), 6) AS DOUBLE) AS VARCHAR) AS anomaly_score FROM scored WHERE is_anomaly"))
def q_report(spark, sf):
    """Flagged rows written as a CSV report and read back."""
    scored = zscore_scored(api_log(spark, sf))
    path = scratch_path(spark, f"report-{uuid.uuid4().hex[:8]}")
    write_report(finish(DT.anomalies(scored)), path)
    return spark.read.options(**RFC_4180).csv(path)


@register("io_feedback_sink", FEEDBACK_SQL)
def q_feedback(spark, sf):
    """Reviewer verdicts appended to a feedback table, read back, measured."""
    scored = zscore_scored(api_log(spark, sf))
    fb = scored.where(F.col("is_anomaly")).select("log_id", (F.col("status_code") >= 400).alias("is_true_anomaly"))
    path = scratch_path(spark, f"feedback-{uuid.uuid4().hex[:8]}")
    write_feedback(fb, path)
    return finish(DT.feedback_metrics(spark.read.parquet(path)))


@register("io_feedback_repeated", with_log(
    SQL_FEATURES_CTE + ZS + " SELECT log_id, CASE WHEN log_id % 3 = 0 THEN status_code < 400 ELSE status_code >= 400 END AS is_true_anomaly FROM scored WHERE is_anomaly"))
def q_feedback_repeated(spark, sf):
    """Two batches of verdicts, each written again as by a retry; the second changes a
    third of the ids. The last verdict of each id counts, once."""
    scored = zscore_scored(api_log(spark, sf))
    first = cut_lineage(scored.where(F.col("is_anomaly")).select("log_id", (F.col("status_code") >= 400).alias("is_true_anomaly")), "verdicts")
    second = first.where(F.col("log_id") % 3 == 0).withColumn("is_true_anomaly", ~F.col("is_true_anomaly"))
    path = scratch_path(spark, f"feedback-{uuid.uuid4().hex[:8]}")
    for batch_id, rows in ((0, first), (1, second), (0, first), (1, second)):
        write_feedback(rows, path, batch_id=batch_id)
    return read_feedback(spark, path)
