"""Registered log queries: profiling, schema mapping, features, counts,
scaling, split/sample, thresholds, detection and review (SURVEY §2.1-2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loghawk.operators import aggregates as AG
from loghawk.operators import detect as DT
from loghawk.operators import features as FE
from loghawk.operators import profile as PR
from loghawk.operators.scaling import fit_scaler, apply_scaler, sample_n, scaler_stats, split, to_vector
from loghawk.operators.schema import detect_roles, map_columns, required_columns_report
from loghawk.operators.sparse import indexed_vocabulary, one_hot_indices
from loghawk.plans.preprocess import ZSCORE_FEATURES, derive_features, zscore_scored
from loghawk.plans.registry import (IPV4, SQL_BUCKET5, SQL_FEATURE_EXPRS, SQL_FEATURES_CTE, finish, register,
                                    sql_finish, sql_zscore_ctes, with_log)
from loghawk.functions.columns import ZERO_SCALE
from loghawk.session import cut_lineage
from loghawk.sources.tables import API_LOG_COLUMNS, api_log

ZS = sql_zscore_ctes(ZSCORE_FEATURES)


def _log(spark, sf):
    return api_log(spark, sf)


# ---------------------------------------------------------------- flagship ----
@register("zscore_top_anomalies", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT log_id, ip_address, request_time, status_code, reconstruction_error, is_anomaly,"
    " anomaly_score FROM scored WHERE is_anomaly ORDER BY anomaly_score DESC, log_id LIMIT 10"),
    doubles=["reconstruction_error", "anomaly_score"], times=["request_time"],
    others=["log_id", "ip_address", "status_code", "is_anomaly"]))
def q_zscore_top(spark, sf):
    return finish(DT.top_anomalies(zscore_scored(_log(spark, sf)), 10))


# --------------------------------------------------------------- profiling ----
@register("profile_shape", with_log(" SELECT count(*) AS rows, CAST(9 AS BIGINT) AS columns FROM api_log"))
def q_shape(spark, sf):
    return PR.shape(_log(spark, sf))


_TYPES = {"log_id": "bigint", "ip_address": "string", "request_time": "timestamp_ntz", "user_agent": "string",
          "endpoint": "string", "method": "string", "parameters": "string", "status_code": "int",
          "response_ms": "double"}
_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS data_type, count(DISTINCT {c}) AS distinct_values,"
    f" count(*) FILTER (WHERE {c} IS NULL) AS nulls,"
    f" count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS null_pct FROM api_log"
    for c, t in _TYPES.items())


@register("profile_columns", sql_finish(with_log(" " + _PROFILE_SQL), doubles=["null_pct"],
                                        others=["column", "data_type", "distinct_values", "nulls"]))
def q_profile_columns(spark, sf):
    return finish(PR.profile_columns(_log(spark, sf)))


@register("profile_columns_sketched", with_log(
    " SELECT \"column\", data_type, nulls, true AS within_three_errors FROM (" + _PROFILE_SQL + ") AS p"))
def q_profile_sketched(spark, sf):
    """Sketches of each day, stored and united: the distinct counts are within three
    standard errors (1 %) of the exact ones."""
    log = _log(spark, sf)
    stored = cut_lineage(PR.column_sketches(log, [F.to_date("request_time").alias("day")]), "column-sketches")
    exact = PR.profile_columns(log).select("column", F.col("distinct_values").alias("exact"))
    both = PR.profile_from_sketches(log, stored).join(exact, "column")
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= 0.03 * F.col("exact")
    return both.select("column", "data_type", "nulls", close.alias("within_three_errors"))


@register("profile_missing_pct", sql_finish(with_log(
    " SELECT (" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in API_LOG_COLUMNS)
    + f") * 100.0 / (count(*) * {len(API_LOG_COLUMNS)}) AS missing_pct FROM api_log"), doubles=["missing_pct"]))
def q_missing(spark, sf):
    return finish(PR.missing_pct(_log(spark, sf)))


_RAW = [c for c in API_LOG_COLUMNS if c != "log_id"]


@register("profile_duplicate_pct", sql_finish(with_log(
    f" , g AS (SELECT count(*) AS c FROM api_log GROUP BY {', '.join(_RAW)})"
    " SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c) - count(*) AS BIGINT) AS duplicates,"
    " (sum(c) - count(*)) * 100.0 / sum(c) AS duplicate_pct FROM g"), doubles=["duplicate_pct"],
    others=["rows", "duplicates"]))
def q_duplicates(spark, sf):
    # the raw log columns (the id would make every row unique)
    return finish(PR.duplicate_pct(_log(spark, sf).select(*_RAW)))


_TYPE_GROUPS = [("bigint", ["log_id"]), ("double", ["response_ms"]), ("int", ["status_code"]),
                 ("string", ["ip_address", "user_agent", "endpoint", "method", "parameters"]),
                 ("timestamp_ntz", ["request_time"]), ("group:numeric", ["log_id", "status_code", "response_ms"]),
                 ("group:string", ["ip_address", "user_agent", "endpoint", "method", "parameters"])]


@register("profile_type_counts", with_log(" " + " UNION ALL ".join(
    f"SELECT '{t}' AS data_type, CAST({len(cs)} AS BIGINT) AS columns, CAST("
    + " + ".join(f"count({c})" for c in cs) + " AS BIGINT) AS non_null_cells FROM api_log" for t, cs in _TYPE_GROUPS)))
def q_type_counts(spark, sf):
    return PR.type_counts(_log(spark, sf))


_NM_COLS = ["user_agent", "parameters", "request_time"]


@register("profile_null_map", with_log(
    " , mm AS (SELECT min(log_id) AS lo, max(log_id) AS hi FROM api_log)"
    ", b AS (SELECT CAST(least(floor((log_id - lo) * 20 / (hi - lo + 1)), 19) AS INTEGER) AS bucket, "
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS m_{c}" for c in _NM_COLS)
    + " FROM api_log, mm GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT bucket, '{c}' AS column, m_{c} AS nulls FROM b" for c in _NM_COLS)))
def q_null_map(spark, sf):
    return PR.null_map(_log(spark, sf), _NM_COLS, 20)


@register("profile_head", sql_finish(with_log(" SELECT * FROM api_log ORDER BY log_id LIMIT 5"),
                                     doubles=["response_ms"], times=["request_time"],
                                     others=[c for c in API_LOG_COLUMNS if c not in ("response_ms", "request_time")]))
def q_head(spark, sf):
    return finish(PR.head(_log(spark, sf), 5))


def _hist_sql(expr: str, bins: int, src: str = "api_log") -> str:
    return with_log(
        f" , v AS (SELECT CAST({expr} AS DOUBLE) AS v FROM {src} WHERE {expr} IS NOT NULL)"
        ", mm AS (SELECT min(v) AS lo, max(v) AS hi FROM v)"
        f", w AS (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1.0 END AS width FROM mm)"
        f", c AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / width), {bins - 1}) ELSE 0 END AS INTEGER) AS bin,"
        " count(*) AS cnt FROM v, w GROUP BY 1)"
        f", e AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))"
        " SELECT e.bin, lo + e.bin * width AS bin_start, lo + (e.bin + 1) * width AS bin_end,"
        " COALESCE(c.cnt, 0) AS count FROM e CROSS JOIN w LEFT JOIN c ON e.bin = c.bin")


@register("profile_histogram_response_ms", sql_finish(_hist_sql("response_ms", 50), doubles=["bin_start", "bin_end"],
                                                      others=["bin", "count"]))
def q_hist_resp(spark, sf):
    return finish(PR.histogram(_log(spark, sf), "response_ms", 50))


@register("profile_histogram_hour", sql_finish(_hist_sql("hour(request_time)", 24), doubles=["bin_start", "bin_end"],
                                               others=["bin", "count"]))
def q_hist_hour(spark, sf):
    log = FE.time_features(_log(spark, sf), "request_time")
    return finish(PR.histogram(log, "request_time_hour", 24))


@register("profile_mean_std", sql_finish(with_log(
    " , f0 AS (SELECT *, " + SQL_FEATURE_EXPRS["request_time_hour"] + " AS request_time_hour FROM api_log) "
    + " UNION ALL ".join(f"SELECT '{c}' AS column, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std FROM f0"
                         for c in ["request_time_hour", "response_ms", "status_code"])),
    doubles=["mean", "std"], others=["column"]))
def q_mean_std(spark, sf):
    log = FE.time_features(_log(spark, sf), "request_time")
    return finish(PR.mean_std(log, ["request_time_hour", "response_ms", "status_code"]))


@register("profile_top_endpoints", with_log(
    " SELECT endpoint AS value, count(*) AS count FROM api_log WHERE endpoint IS NOT NULL"
    " GROUP BY endpoint ORDER BY count DESC, value LIMIT 10"))
def q_top_values(spark, sf):
    return PR.top_values(_log(spark, sf), "endpoint", 10)


@register("profile_top_user_agents", with_log(
    " SELECT user_agent AS value, count(*) AS count FROM api_log WHERE user_agent IS NOT NULL"
    " GROUP BY user_agent ORDER BY count DESC, value LIMIT 10"))
def q_top_ua(spark, sf):
    return PR.top_values(_log(spark, sf), "user_agent", 10)


# ------------------------------------------------------------------ schema ----
# The roles of the api_log columns (same in both modes).
_ROLE_ROWS = [("time", "request_time"), ("ip", "ip_address"), ("ua", "user_agent"), ("endpoint", "endpoint"),
              ("status", "status_code")]


@register("schema_roles", with_log(" " + " UNION ALL ".join(
    f"SELECT '{m}' AS mode, '{r}' AS role, '{c}' AS column, count({c}) AS non_null FROM api_log"
    for m in ("typed", "keyword") for r, c in _ROLE_ROWS)))
def q_roles(spark, sf):
    """Roles found in the api_log schema in both detection modes, with the
    non-NULL values each role column offers (one aggregate over the log)."""
    log = _log(spark, sf)
    found = [(mode, role, c) for mode in ("typed", "keyword")
             for role, cols in detect_roles(log.schema, mode).items() for c in cols]
    cols = sorted({c for _, _, c in found})
    counts = log.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    rows = ", ".join(f"'{m}', '{r}', '{c}', `{c}`" for m, r, c in found)
    return counts.selectExpr(f"stack({len(found)}, {rows}) AS (mode, role, column, non_null)")


# How the required names meet the api_log columns (prefix rule).
_REQUIRED_MATCH = [("ip_address", "ip_address"), ("timestamp", None), ("user_agent", "user_agent"),
                   ("endpoint", "endpoint"), ("parameters", "parameters"), ("status_code", "status_code"),
                   ("response_time", None)]


@register("schema_missing_columns", with_log(" " + " UNION ALL ".join(
    f"SELECT '{r}' AS required, " + (f"'{m}' AS matched_column, count({m}) AS non_null FROM api_log" if m else
                                     "CAST(NULL AS VARCHAR) AS matched_column, CAST(0 AS BIGINT) AS non_null")
    for r, m in _REQUIRED_MATCH)))
def q_missing_cols(spark, sf):
    """Required columns: which api_log column meets each (none for the missing
    'timestamp' and 'response_time') and how many values it offers."""
    return required_columns_report(_log(spark, sf))


@register("schema_map_columns", sql_finish(with_log(
    " SELECT log_id, request_time AS timestamp, response_ms AS response_time, ip_address FROM api_log"),
    doubles=["response_time"], times=["timestamp"], others=["log_id", "ip_address"]))
def q_map(spark, sf):
    log = _log(spark, sf)
    mapped = map_columns(log, {"timestamp": "request_time", "response_time": "response_ms"})
    return finish(mapped.select("log_id", "timestamp", "response_time", "ip_address"))


# ---------------------------------------------------------------- features ----
@register("features_parse_time", with_log(
    " SELECT log_id, CAST(try_strptime(strftime(request_time, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') IS NOT NULL AS BOOLEAN) AS parsed,"
    " CAST(hour(try_strptime(strftime(request_time, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')) AS INTEGER) AS hour FROM api_log"))
def q_parse_time(spark, sf):
    """Round-trip the time through text, as a CSV log holds it, and parse it back."""
    log = _log(spark, sf).select("log_id", F.date_format("request_time", "yyyy-MM-dd HH:mm:ss").alias("t"))
    parsed = FE.parse_time(log, "t", "yyyy-MM-dd HH:mm:ss")
    return parsed.select("log_id", F.col("t").isNotNull().alias("parsed"), F.hour("t").alias("hour"))


_TIME_COLS = ["request_time_hour", "request_time_day", "request_time_dayofweek"]


@register("features_time_parts", with_log(
    " SELECT log_id, " + ", ".join(f"{SQL_FEATURE_EXPRS[c]} AS {c}" for c in _TIME_COLS) + " FROM api_log"))
def q_time_parts(spark, sf):
    return FE.time_features(_log(spark, sf), "request_time").select("log_id", *_TIME_COLS)


@register("features_has_ipv4", with_log(
    f" SELECT COALESCE(bool_or(regexp_matches(ip_address, '{IPV4}')), false) AS has_ipv4 FROM api_log"))
def q_has_ipv4(spark, sf):
    return FE.has_ipv4(_log(spark, sf), "ip_address")


_OCT = ["ip_address_first_octet", "ip_address_second_octet"]


@register("features_ip_octets", sql_finish(with_log(
    " SELECT log_id, " + ", ".join(f"{SQL_FEATURE_EXPRS[c]} AS {c}" for c in _OCT) + " FROM api_log"),
    doubles=_OCT, others=["log_id"]))
def q_octets(spark, sf):
    return finish(FE.ip_octets(_log(spark, sf), "ip_address").select("log_id", *_OCT))


_UA = ["user_agent_is_mobile", "user_agent_is_chrome", "user_agent_is_firefox", "user_agent_is_safari"]


@register("features_ua_flags", with_log(
    " SELECT log_id, " + ", ".join(f"{SQL_FEATURE_EXPRS[c]} AS {c}" for c in _UA) + " FROM api_log"))
def q_ua(spark, sf):
    return FE.ua_flags(_log(spark, sf), "user_agent").select("log_id", *_UA)


@register("features_ua_totals", sql_finish(with_log(
    " , f0 AS (SELECT " + ", ".join(f"{SQL_FEATURE_EXPRS[c]} AS {c}" for c in _UA) + " FROM api_log) "
    + " UNION ALL ".join(f"SELECT '{c}' AS flag, CAST(sum({c}) AS BIGINT) AS total, sum({c}) * 100.0 / count(*) AS pct FROM f0"
                         for c in _UA)), doubles=["pct"], others=["flag", "total"]))
def q_ua_totals(spark, sf):
    return finish(FE.ua_totals(_log(spark, sf), "user_agent"))


@register("features_one_hot_endpoint", with_log(
    " SELECT log_id, " + ", ".join(
        f"COALESCE(CAST(endpoint = '/api/{e}' AS INTEGER), 0) AS \"endpoint_endpoint_/api/{e}\""
        for e in sorted(["click", "error", "purchase", "signup", "view"])) + " FROM api_log"))
def q_one_hot(spark, sf):
    out, vocab = FE.one_hot(_log(spark, sf), "endpoint")
    return out.select("log_id", *[f"`endpoint_endpoint_{v}`" for v in vocab])


@register("features_one_hot_totals", with_log(
    " SELECT endpoint AS value, count(*) AS total FROM api_log WHERE endpoint IS NOT NULL GROUP BY endpoint"))
def q_one_hot_totals(spark, sf):
    return FE.one_hot_totals(_log(spark, sf), "endpoint")


_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)"


@register("features_url_one_hot", with_log(
    f" SELECT page_id, 'host_endpoint_' || regexp_extract(url, '{_HOST_RE}', 1) AS hot_column FROM pages"))
def q_url_one_hot(spark, sf):
    """Many-valued one-hot in sparse form: the hot column of each page's host, no cap."""
    from loghawk.sources.tables import read_table
    pages = read_table(spark, sf, "pages").select("page_id", F.parse_url(F.col("url"), F.lit("HOST")).alias("host"))
    out = FE.one_hot_rows(pages, "host", FE.endpoint_vocabulary(pages, "host"), "page_id")
    return out.select("page_id", F.col("hot").alias("hot_column"))


@register("features_one_hot_at_serving", with_log(
    " SELECT log_id, CASE WHEN log_id % 2 = 0 THEN 'all' ELSE 'new' END AS part,"
    " CASE WHEN method = 'POST' AND log_id % 2 = 1 THEN NULL ELSE 'endpoint_endpoint_' || endpoint END AS hot_column FROM api_log"))
def q_one_hot_serving(spark, sf):
    """A vocabulary fitted on the log serves the same log and one with unseen
    endpoints (odd POST rows get a suffix): same names, all zeros for the unseen."""
    log = _log(spark, sf).select("log_id", "endpoint", "method")
    vocabulary = FE.endpoint_vocabulary(log, "endpoint")
    odd = F.col("log_id") % 2 == 1
    served = log.withColumn("endpoint", F.when(odd & (F.col("method") == "POST"), F.concat("endpoint", F.lit("/v2"))).otherwise(F.col("endpoint")))
    out = FE.one_hot_rows(served, "endpoint", vocabulary)
    return out.select("log_id", F.when(odd, "new").otherwise("all").alias("part"), F.col("hot").alias("hot_column"))


@register("features_one_hot_indices", with_log(
    ", voc AS (SELECT endpoint, row_number() OVER (ORDER BY endpoint) - 1 AS i FROM (SELECT DISTINCT endpoint FROM api_log WHERE endpoint IS NOT NULL)),"
    " met AS (SELECT method, row_number() OVER (ORDER BY method) - 1 + (SELECT count(*) FROM voc) AS i FROM (SELECT DISTINCT method FROM api_log))"
    " SELECT log_id, CAST(voc.i AS INTEGER) AS endpoint_index, CAST(met.i AS INTEGER) AS method_index, 2.0::DOUBLE AS total FROM api_log JOIN voc USING (endpoint) JOIN met USING (method)"))
def q_one_hot_indices(spark, sf):
    """Two columns' one-hots as indices and values over one line of positions; vocabularies are tables."""
    log = _log(spark, sf).select("log_id", "endpoint", "method")
    out, _ = one_hot_indices(log, {c: indexed_vocabulary(log, c) for c in ("endpoint", "method")})
    total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b)
    return out.select("log_id", F.col("indices")[0].alias("endpoint_index"), F.col("indices")[1].alias("method_index"), total.alias("total"))


@register("features_url_one_hot_indices", (
    "SELECT page_id, CAST(dense_rank() OVER (ORDER BY url) - 1 AS INTEGER) AS url_index FROM pages WHERE url IS NOT NULL"
    " UNION ALL SELECT page_id, NULL FROM pages WHERE url IS NULL"))
def q_url_one_hot_indices(spark, sf):
    """A vocabulary with nearly as many values as rows: dense indices in sorted order."""
    from loghawk.sources.tables import read_table
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    out, _ = one_hot_indices(pages, {"url": indexed_vocabulary(pages, "url")})
    return out.select("page_id", F.when(F.size("indices") > 0, F.col("indices")[0]).alias("url_index"))


_ST = ["status_code_is_success", "status_code_is_redirect", "status_code_is_client_error",
       "status_code_is_server_error"]


@register("features_status_class", with_log(
    " SELECT log_id, " + ", ".join(f"{SQL_FEATURE_EXPRS[c]} AS {c}" for c in _ST) + " FROM api_log"))
def q_status(spark, sf):
    return FE.status_class(_log(spark, sf), "status_code").select("log_id", *_ST)


@register("features_status_totals", sql_finish(with_log(
    " , f0 AS (SELECT " + ", ".join(f"{SQL_FEATURE_EXPRS[c]} AS {c}" for c in _ST) + " FROM api_log) "
    + " UNION ALL ".join(f"SELECT '{c}' AS status_class, CAST(sum({c}) AS BIGINT) AS total,"
                         f" sum({c}) * 100.0 / count(*) AS pct FROM f0" for c in _ST)),
    doubles=["pct"], others=["status_class", "total"]))
def q_status_totals(spark, sf):
    return finish(FE.status_totals(_log(spark, sf), "status_code"))


# Batch path (rule 'source'): derived columns survive; the feature contract.
_BATCH_NAMES = (["status_code", "response_ms"] + _TIME_COLS + _OCT + _UA
                + [f"endpoint_endpoint_/api/{e}" for e in sorted(["click", "error", "purchase", "signup", "view"])]
                + _ST + ["requests_per_ip", "requests_per_ip_5min"])


def _sql_batch_features() -> str:
    ep = ", ".join(f"COALESCE(CAST(endpoint = '/api/{e}' AS INTEGER), 0) AS \"endpoint_endpoint_/api/{e}\""
                   for e in sorted(["click", "error", "purchase", "signup", "view"]))
    return with_log(
        SQL_FEATURES_CTE
        + f", b AS (SELECT ip_address, {SQL_BUCKET5} AS time_interval, count(*) AS n5 FROM api_log"
        " WHERE ip_address IS NOT NULL AND request_time IS NOT NULL GROUP BY 1, 2)"
        f", g AS (SELECT f.*, {ep}, b.n5 AS requests_per_ip_5min FROM f LEFT JOIN b"
        f" ON f.ip_address = b.ip_address AND {SQL_BUCKET5.replace('request_time', 'f.request_time')} = b.time_interval)"
        " SELECT log_id, " + ", ".join(f"COALESCE(\"{c}\", 0) AS \"{c}\"" for c in _BATCH_NAMES) + " FROM g")


@register("features_batch_select", sql_finish(_sql_batch_features(),
                                              doubles=["response_ms"] + _OCT,
                                              others=["log_id"] + [c for c in _BATCH_NAMES
                                                                   if c not in ["response_ms"] + _OCT]))
def q_batch_features(spark, sf):
    out, spec = derive_features(_log(spark, sf), mode="batch")
    return finish(out.select("log_id", *[f"`{c}`" for c in _BATCH_NAMES]))


_WIZARD_NAMES = ["status_code", "response_ms"] + _OCT + _ST + ["requests_per_ip"]


@register("features_wizard_select", sql_finish(with_log(
    SQL_FEATURES_CTE + " SELECT log_id, " + ", ".join(f"COALESCE({c}, 0) AS {c}" for c in _WIZARD_NAMES) + " FROM f"),
    doubles=["response_ms"] + _OCT, others=["log_id"] + [c for c in _WIZARD_NAMES if c not in ["response_ms"] + _OCT]))
def q_wizard_features(spark, sf):
    out, spec = derive_features(_log(spark, sf), mode="wizard")
    return finish(out.select("log_id", *_WIZARD_NAMES))


@register("features_numeric_only", sql_finish(with_log(
    " SELECT log_id, status_code, response_ms FROM api_log"), doubles=["response_ms"], others=["log_id", "status_code"]))
def q_numeric_only(spark, sf):
    return finish(FE.numeric_only(_log(spark, sf)))


@register("features_fill_missing", with_log(
    " SELECT log_id, " + ", ".join(f"{SQL_FEATURE_EXPRS[c]} AS {c}" for c in _UA[:1])
    + f", COALESCE({SQL_FEATURE_EXPRS['ip_address_first_octet']}, 0) AS first_octet,"
    " COALESCE(CAST(length(user_agent) AS INTEGER), 0) AS ua_length FROM api_log"))
def q_fill(spark, sf):
    log = FE.ip_octets(FE.ua_flags(_log(spark, sf), "user_agent"), "ip_address")
    log = log.select("log_id", "user_agent_is_mobile", F.col("ip_address_first_octet").alias("first_octet"),
                     F.length("user_agent").alias("ua_length"))
    return FE.fill_missing(log, ["first_octet", "ua_length"])


@register("features_parse_params", with_log(
    " SELECT log_id, json_extract_string(parameters, '$.k') AS k,"
    " CAST(COALESCE(len(json_keys(parameters)), 0) AS INTEGER) AS parameters_n_keys FROM api_log"))
def q_params(spark, sf):
    out = FE.parse_params(_log(spark, sf), "parameters")
    return out.select("log_id", F.col("parameters_map")["k"].alias("k"), "parameters_n_keys")


# -------------------------------------------------------- counts and joins ----
@register("agg_requests_per_ip", with_log(
    " SELECT ip_address, count(*) AS requests_per_ip FROM api_log WHERE ip_address IS NOT NULL GROUP BY ip_address"))
def q_rpi(spark, sf):
    return AG.requests_per_ip(_log(spark, sf))


@register("agg_time_interval", with_log(
    f" SELECT log_id, strftime({SQL_BUCKET5}, '%Y-%m-%d %H:%M:%S.%f') AS time_interval FROM api_log"))
def q_interval(spark, sf):
    return finish(AG.time_interval(_log(spark, sf), "request_time").select("log_id", "time_interval"))


@register("agg_requests_per_ip_5min", with_log(
    f" SELECT ip_address, strftime({SQL_BUCKET5}, '%Y-%m-%d %H:%M:%S.%f') AS time_interval, count(*) AS requests_per_ip_5min"
    " FROM api_log WHERE ip_address IS NOT NULL AND request_time IS NOT NULL GROUP BY 1, 2"))
def q_rpi5(spark, sf):
    return finish(AG.requests_per_ip_window(_log(spark, sf)))


@register("join_requests_per_ip", with_log(
    " , c AS (SELECT ip_address, count(*) AS requests_per_ip FROM api_log WHERE ip_address IS NOT NULL GROUP BY 1)"
    " SELECT l.log_id, l.ip_address, c.requests_per_ip FROM api_log l LEFT JOIN c ON l.ip_address = c.ip_address"))
def q_jn1(spark, sf):
    return AG.with_requests_per_ip(_log(spark, sf)).select("log_id", "ip_address", "requests_per_ip")


@register("join_requests_per_ip_5min", with_log(
    f" , c AS (SELECT ip_address, {SQL_BUCKET5} AS b, count(*) AS n FROM api_log"
    " WHERE ip_address IS NOT NULL AND request_time IS NOT NULL GROUP BY 1, 2)"
    f" SELECT l.log_id, strftime({SQL_BUCKET5.replace('request_time', 'l.request_time')}, '%Y-%m-%d %H:%M:%S.%f') AS time_interval,"
    f" c.n AS requests_per_ip_5min FROM api_log l LEFT JOIN c ON l.ip_address = c.ip_address"
    f" AND {SQL_BUCKET5.replace('request_time', 'l.request_time')} = c.b"))
def q_jn2(spark, sf):
    return finish(AG.with_requests_per_ip_window(_log(spark, sf)).select("log_id", "time_interval",
                                                                        "requests_per_ip_5min"))


@register("join_request_counts_single_pass", with_log(
    " , c1 AS (SELECT ip_address, count(*) AS n FROM api_log WHERE ip_address IS NOT NULL GROUP BY 1)"
    f", c2 AS (SELECT ip_address, {SQL_BUCKET5} AS b, count(*) AS n FROM api_log"
    " WHERE ip_address IS NOT NULL AND request_time IS NOT NULL GROUP BY 1, 2)"
    " SELECT l.log_id, c1.n AS requests_per_ip, c2.n AS requests_per_ip_5min FROM api_log l"
    " LEFT JOIN c1 ON l.ip_address = c1.ip_address"
    f" LEFT JOIN c2 ON l.ip_address = c2.ip_address AND {SQL_BUCKET5.replace('request_time', 'l.request_time')} = c2.b"))
def q_counts_once(spark, sf):
    out = AG.with_request_counts(_log(spark, sf))
    return out.select("log_id", F.col("requests_per_ip").cast("long").alias("requests_per_ip"),
                      F.col("requests_per_ip_5min").cast("long").alias("requests_per_ip_5min"))


@register("agg_top_ips", with_log(
    " SELECT ip_address, count(*) AS requests FROM api_log WHERE ip_address IS NOT NULL"
    " GROUP BY 1 ORDER BY requests DESC, ip_address LIMIT 20"))
def q_top_ips(spark, sf):
    return AG.top_ips(_log(spark, sf), k=20)


@register("agg_ip_summary", sql_finish(with_log(
    " , c AS (SELECT ip_address, count(*) AS n FROM api_log WHERE ip_address IS NOT NULL GROUP BY 1)"
    " SELECT count(*) AS unique_ips, avg(n) AS mean_requests_per_ip FROM c"),
    doubles=["mean_requests_per_ip"], others=["unique_ips"]))
def q_ip_summary(spark, sf):
    return finish(AG.ip_summary(_log(spark, sf)))


# ------------------------------------------------------------------ scaling ----
_SC = ["response_ms", "request_time_hour", "status_code"]


@register("scale_fit", sql_finish(with_log(
    " , f0 AS (SELECT *, " + SQL_FEATURE_EXPRS["request_time_hour"] + " AS request_time_hour FROM api_log) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS std FROM f0"
                         for c in _SC)), doubles=["mean", "std"], others=["feature"]))
def q_scale_fit(spark, sf):
    log = FE.time_features(_log(spark, sf), "request_time")
    return finish(scaler_stats(fit_scaler(log, _SC)))


@register("scale_apply", sql_finish(with_log(
    " , f0 AS (SELECT *, " + SQL_FEATURE_EXPRS["request_time_hour"] + " AS request_time_hour FROM api_log)"
    ", s AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in _SC)
    + " FROM f0) SELECT log_id, " + ", ".join(
        f"CASE WHEN s_{c} IS NULL OR s_{c} <= {ZERO_SCALE!r} THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS {c}" for c in _SC)
    + " FROM f0, s"), doubles=_SC, others=["log_id"]))
def q_scale_apply(spark, sf):
    log = FE.time_features(_log(spark, sf), "request_time").select("log_id", *_SC)
    return finish(apply_scaler(log, fit_scaler(log, _SC).collect()))


@register("scale_to_vector", sql_finish(with_log(
    " , v AS (SELECT log_id, [CAST(status_code AS DOUBLE), response_ms, CAST(hour(request_time) AS DOUBLE)] AS features"
    " FROM api_log) SELECT log_id, CAST(len(features) AS INTEGER) AS dim, features[1] AS v0, features[2] AS v1,"
    " features[3] AS v2 FROM v"), doubles=["v0", "v1", "v2"], others=["log_id", "dim"]))
def q_vector(spark, sf):
    """The ordered feature vector, reported as its length and elements."""
    log = FE.time_features(_log(spark, sf), "request_time")
    vec = to_vector(log, ["status_code", "response_ms", "request_time_hour"])
    return finish(vec.select("log_id", F.size("features").alias("dim"),
                             *[F.col("features")[i].alias(f"v{i}") for i in range(3)]))


@register("split_train_test", with_log(
    " SELECT CASE WHEN substr(md5('42|' || CAST(log_id AS VARCHAR)), 1, 8) < 'cccccccd' THEN 'train' ELSE 'test' END AS split,"
    " count(*) AS rows FROM api_log GROUP BY 1"))
def q_split(spark, sf):
    return split(_log(spark, sf), 0.8, 42).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@register("sample_fixed_size", with_log(
    " SELECT log_id, endpoint FROM api_log ORDER BY md5('7|' || CAST(log_id AS VARCHAR)), log_id LIMIT 1000"))
def q_sample(spark, sf):
    return sample_n(_log(spark, sf), 1000, 7).select("log_id", "endpoint")


# -------------------------------------------------- thresholds and flags ----
def _scored(spark, sf):
    return zscore_scored(_log(spark, sf))


@register("threshold_std", sql_finish(with_log(SQL_FEATURES_CTE + ZS + " SELECT threshold FROM t"),
                                      doubles=["threshold"]))
def q_th_std(spark, sf):
    return finish(DT.threshold(_scored(spark, sf), method="std"))


@register("threshold_percentile", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT quantile_cont(reconstruction_error, 0.99) AS threshold FROM z"),
    doubles=["threshold"]))
def q_th_pct(spark, sf):
    return finish(DT.threshold(_scored(spark, sf), method="percentile", contamination=0.01))


@register("threshold_percentile_approx", with_log(" SELECT count(*) AS total, true AS within_error FROM api_log"))
def q_th_approx(spark, sf):
    """The percentile from the sketch alone: its rank is within 1 / 20,000 of the rows of the wanted one."""
    scored = cut_lineage(_scored(spark, sf), "scored")
    t = DT.threshold(scored, method="percentile", contamination=0.01, exact=False, accuracy=20_000).select("threshold").scalar()
    e = F.col("reconstruction_error")
    n = F.count(F.lit(1))
    low, high = F.count_if(e < t), F.count_if(e <= t)
    slack = n / 20_000 + 1
    return scored.agg(n.alias("total"), ((low <= 0.99 * n + slack) & (high >= 0.99 * n - slack)).alias("within_error"))


@register("detect_flag_score", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT log_id, reconstruction_error, is_anomaly, anomaly_score FROM scored"),
    doubles=["reconstruction_error", "anomaly_score"], others=["log_id", "is_anomaly"]))
def q_flag(spark, sf):
    return finish(_scored(spark, sf).select("log_id", "reconstruction_error", "is_anomaly", "anomaly_score"))


@register("detect_mean_loss", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT avg(reconstruction_error) AS mean_loss FROM z"), doubles=["mean_loss"]))
def q_mean_loss(spark, sf):
    return finish(DT.mean_loss(_scored(spark, sf)))


@register("detect_summary", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalies,"
    " count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*) AS anomaly_pct FROM scored"),
    doubles=["anomaly_pct"], others=["total", "anomalies"]))
def q_summary(spark, sf):
    return finish(DT.summary(_scored(spark, sf)))


@register("detect_anomalies_ranked", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT log_id, ip_address, anomaly_score FROM scored WHERE is_anomaly"),
    doubles=["anomaly_score"], others=["log_id", "ip_address"]))
def q_ranked(spark, sf):
    return finish(DT.anomalies(_scored(spark, sf)).select("log_id", "ip_address", "anomaly_score"))


@register("detect_score_series", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT date_trunc('hour', request_time) AS bucket, count(*) AS requests,"
    " count(*) FILTER (WHERE is_anomaly) AS anomalies, max(anomaly_score) AS max_score, avg(anomaly_score) AS mean_score"
    " FROM scored WHERE request_time IS NOT NULL GROUP BY 1"),
    doubles=["max_score", "mean_score"], times=["bucket"], others=["requests", "anomalies"]))
def q_series(spark, sf):
    return finish(DT.score_series(_scored(spark, sf), "request_time", 60))


def _feedback(scored):
    """Reviewer verdicts derived from the data: a flagged request is a true
    anomaly when it also failed (status >= 400)."""
    return scored.where(F.col("is_anomaly")).select("log_id", (F.col("status_code") >= 400).alias("is_true_anomaly"))


_FB_SQL = ", fb AS (SELECT log_id, status_code >= 400 AS is_true_anomaly FROM scored WHERE is_anomaly)"


@register("review_select_feedback", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + _FB_SQL + " SELECT s.log_id, s.anomaly_score, fb.is_true_anomaly FROM scored s"
    " JOIN fb ON s.log_id = fb.log_id"), doubles=["anomaly_score"], others=["log_id", "is_true_anomaly"]))
def q_fb_select(spark, sf):
    scored = cut_lineage(_scored(spark, sf), "scored")
    return finish(DT.select_feedback(scored, _feedback(scored)).select("log_id", "anomaly_score", "is_true_anomaly"))


@register("review_feedback_metrics", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + _FB_SQL + " SELECT count(*) FILTER (WHERE is_true_anomaly) AS true_positives,"
    " count(*) FILTER (WHERE NOT is_true_anomaly) AS false_positives,"
    " CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_true_anomaly) / count(*) ELSE 0.0 END AS precision FROM fb"),
    doubles=["precision"], others=["true_positives", "false_positives"]))
def q_fb_metrics(spark, sf):
    return finish(DT.feedback_metrics(_feedback(_scored(spark, sf))))


@register("review_rethreshold", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT count(*) AS total, count(*) FILTER (WHERE reconstruction_error > threshold) AS anomalies_old,"
    " count(*) FILTER (WHERE reconstruction_error > 1.5) AS anomalies_new,"
    " count(*) FILTER (WHERE reconstruction_error > threshold) * 100.0 / count(*) AS pct_old,"
    " count(*) FILTER (WHERE reconstruction_error > 1.5) * 100.0 / count(*) AS pct_new FROM z, t"),
    doubles=["pct_old", "pct_new"], others=["total", "anomalies_old", "anomalies_new"]))
def q_rethreshold(spark, sf):
    scored = cut_lineage(_scored(spark, sf).select("log_id", "reconstruction_error"), "scored")
    old = DT.threshold(scored, method="std").first()[0]
    return finish(DT.rethreshold_summary(scored, old, 1.5))


@register("review_rethreshold_rows", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + " SELECT log_id, reconstruction_error > 1.5 AS is_anomaly_new,"
    " reconstruction_error / 1.5 AS anomaly_score_new FROM z"),
    doubles=["anomaly_score_new"], others=["log_id", "is_anomaly_new"]))
def q_rethreshold_rows(spark, sf):
    return finish(DT.rethreshold(_scored(spark, sf), 1.5).select("log_id", "is_anomaly_new", "anomaly_score_new"))


@register("review_suppress_false_positives", sql_finish(with_log(
    SQL_FEATURES_CTE + ZS + ", fb AS (SELECT endpoint, ip_address, bool_or(s.status_code >= 400) AS ok FROM scored s JOIN api_log l USING (log_id, ip_address) WHERE is_anomaly AND log_id % 2 = 0 GROUP BY ALL)"
    " SELECT log_id, is_anomaly AND COALESCE(ok, true) AS is_anomaly, is_anomaly AND NOT COALESCE(ok, true) AS suppressed"
    " FROM scored JOIN api_log l USING (log_id, ip_address) LEFT JOIN fb USING (endpoint, ip_address)"), others=["log_id", "is_anomaly", "suppressed"]))
def q_suppress(spark, sf):
    """Flags on an IP and endpoint whose reviewed flags were all false alarms are taken back."""
    log = _log(spark, sf).select("log_id", "endpoint")
    scored = cut_lineage(_scored(spark, sf).select("log_id", "ip_address", "status_code", "is_anomaly").join(log, "log_id"), "scored")
    seen = scored.where(F.col("is_anomaly") & (F.col("log_id") % 2 == 0)).select("ip_address", "endpoint", (F.col("status_code") >= 400).alias("is_true_anomaly"))
    return DT.suppress(scored, seen, ["ip_address", "endpoint"]).select("log_id", "is_anomaly", "suppressed")
