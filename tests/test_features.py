"""Edge cases of the scalar features, counts, scaler, flags and profiles."""

import datetime as dt
import math

from pyspark.sql import functions as F

from loghawk.operators import aggregates as AG
from loghawk.operators import detect as DT
from loghawk.operators import features as FE
from loghawk.operators import profile as PR
from loghawk.operators.scaling import apply_scaler, fit_scaler, sample_n, split
from loghawk.operators.schema import detect_roles, missing_columns
from loghawk.sources.logs import RAW_LOG_SCHEMA


def test_ip_octets_null_and_malformed(spark):
    df = spark.createDataFrame([(1, "1.2.3.4"), (2, None), (3, "x"), (4, "1.2.3"), (5, "999.1.1.1"),
                                (6, "ip=10.20.30.40;")], "log_id long, ip string")
    got = {r.log_id: (r.ip_first_octet, r.ip_second_octet) for r in FE.ip_octets(df, "ip").collect()}
    assert got[1] == (1.0, 2.0)
    assert got[2] == (None, None) and got[3] == (None, None) and got[4] == (None, None)
    assert got[5] == (999.0, 1.0)        # no range check
    assert got[6] == (10.0, 20.0)        # unanchored


def test_null_ip_gets_no_count(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "log_id long, ip_address string")
    got = {r.log_id: r.requests_per_ip for r in AG.with_requests_per_ip(df).collect()}
    assert got == {1: 2, 2: 2, 3: None, 4: None}


def test_unparsable_time_kept(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "garbage"), (3, None)], "log_id long, t string")
    out = FE.time_features(FE.parse_time(df, "t"), "t").orderBy("log_id").collect()
    assert len(out) == 3
    assert out[0].t_hour == 10 and out[0].t_dayofweek == 0
    assert out[1].t is None and out[1].t_hour is None


def test_window_count_keeps_null_time_rows(spark):
    rows = [(1, "a", dt.datetime(2024, 1, 1, 0, 1)), (2, "a", dt.datetime(2024, 1, 1, 0, 4)),
            (3, "a", dt.datetime(2024, 1, 1, 0, 6)), (4, "a", None), (5, None, dt.datetime(2024, 1, 1, 0, 2))]
    df = spark.createDataFrame(rows, "log_id long, ip_address string, request_time timestamp_ntz")
    got = {r.log_id: (r.requests_per_ip, r.requests_per_ip_5min) for r in AG.with_request_counts(df).collect()}
    assert got == {1: (4, 2), 2: (4, 2), 3: (4, 1), 4: (4, None), 5: (None, None)}
    two = {r.log_id: r.requests_per_ip_5min for r in AG.with_requests_per_ip_window(df).collect()}
    assert two == {1: 2, 2: 2, 3: 1, 4: None, 5: None}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "log_id long, c double, v double")
    out = apply_scaler(df, fit_scaler(df, ["c", "v"])).orderBy("log_id").collect()
    assert [r.c for r in out] == [0.0, 0.0]
    assert [r.v for r in out] == [-1.0, 1.0]     # population std


def test_scaler_on_own_data_mean0_std1(spark):
    df = spark.range(200).select(F.col("id").alias("log_id"), (F.col("id") * 3.7 % 17).alias("x"))
    z = apply_scaler(df, fit_scaler(df, ["x"]))
    r = z.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9


def test_histogram_constant_and_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "x double")
    h = PR.histogram(df, "x", 5).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 3 and h[0]["count"] == 3
    df2 = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "x double")
    h2 = PR.histogram(df2, "x", 2).orderBy("bin").collect()
    assert [r["count"] for r in h2] == [1, 2]    # last bin closed


def test_unseen_endpoint_all_zero(spark):
    df = spark.createDataFrame([(1, "/a"), (2, "/new"), (3, None)], "log_id long, endpoint string")
    out, vocab = FE.one_hot(df, "endpoint", values=["/a", "/b"])
    rows = {r.log_id: (r["endpoint_endpoint_/a"], r["endpoint_endpoint_/b"]) for r in out.collect()}
    assert rows == {1: (1, 0), 2: (0, 0), 3: (0, 0)}


def test_one_hot_has_every_value(spark):
    df = spark.createDataFrame([(i, f"/e{i % 300}") for i in range(900)] + [(901, None), (902, "other")], "log_id long, endpoint string")
    out, vocab = FE.one_hot(df, "endpoint")
    assert len(vocab) == 301 and out.agg(F.sum("endpoint_endpoint_other")).first()[0] == 1
    served, again = FE.one_hot(df.where("log_id < 3"), "endpoint", vocab)
    assert again == vocab and served.columns == out.columns
    hot = {r.log_id: r.hot for r in FE.one_hot_rows(df, "endpoint", FE.endpoint_vocabulary(df, "endpoint").where("value <> '/e1'")).collect()}
    assert hot[0] == "endpoint_endpoint_/e0" and hot[1] is None and hot[901] is None and len(hot) == 902


def test_scoring_keeps_the_log_and_wants_its_features(spark):
    import pytest
    from loghawk.plans.detection import prepare, score_log, train_detector
    from loghawk.sources.tables import api_log
    log = api_log(spark, "/root/testdata/sf0.001")
    model, spec = train_detector(log, epochs=1, hidden=(4,))
    odd = log.limit(5).union(log.limit(1).withColumn("log_id", F.lit(None).cast("long")))
    scored = score_log(odd, model, spec)
    assert scored.columns == log.columns + ["reconstruction_error", "is_anomaly", "anomaly_score"]
    assert scored.count() == 6 and scored.where("log_id is null and reconstruction_error is not null").count() == 1
    with pytest.raises(ValueError, match="response_ms"):
        score_log(log.drop("response_ms"), model, spec)
    spec.scale_onehot = False
    vec, _, scaler = prepare(log, spec)
    at = spec.names.index(sorted(spec.onehot_names())[0])
    assert {r[0] for r in vec.select(F.col("features")[at]).distinct().collect()} <= {0.0, 1.0}
    assert not set(scaler.columns) & spec.onehot_names()


def test_threshold_equal_not_flagged_and_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 0.5)], "log_id long, reconstruction_error double")
    out = DT.flag_and_score(df, 1.0)
    flags = {r.log_id: r.is_anomaly for r in out.collect()}
    assert flags == {1: False, 2: True, 3: True, 4: False}
    top = [r.log_id for r in DT.top_anomalies(out, 2).collect()]
    assert top == [2, 3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "log_id long, reconstruction_error double, is_anomaly boolean")
    s = DT.summary(df).first()
    assert s.total == 0 and s.anomalies == 0 and s.anomaly_pct is None
    fb = DT.feedback_metrics(spark.createDataFrame([], "log_id long, is_true_anomaly boolean")).first()
    assert fb.precision == 0.0


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a"), (3, "b")], "a int, b string")
    r = PR.duplicate_pct(df).first()
    assert r.duplicates == 3 and math.isclose(r.duplicate_pct, 50.0)


def test_roles_and_required(spark):
    schema = RAW_LOG_SCHEMA
    kw = detect_roles(schema, "keyword")
    typed = detect_roles(schema, "typed")
    assert "response_time_ms" in kw["time"] and "response_time_ms" not in typed["time"]
    assert kw["ip"] == ["ip_address"] and "status_code" in typed["status"]
    assert missing_columns(schema) == []


def test_split_and_sample_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "log_id")
    a = split(df.repartition(7), 0.8, 1).where("split = 'train'").count()
    b = split(df.repartition(2), 0.8, 1).where("split = 'train'").count()
    assert a == b and 3800 < a < 4200
    s1 = [r.log_id for r in sample_n(df.repartition(5), 10, 3).collect()]
    s2 = [r.log_id for r in sample_n(df, 10, 3).collect()]
    assert s1 == s2 and len(s1) == 10


def test_salted_join_equals_plain(spark):
    from loghawk.plans.joins import lookup_join
    rows = [(i, "hot" if i % 3 else f"ip{i % 11}") for i in range(3000)] + [(5000, None)]
    df = spark.createDataFrame(rows, "log_id long, ip_address string")
    counts = AG.requests_per_ip(df)
    plain = {r.log_id: r.requests_per_ip for r in lookup_join(df, counts, "ip_address").collect()}
    salted = {r.log_id: r.requests_per_ip for r in lookup_join(df, counts, "ip_address",
                                                                  salt_buckets=8, salt_source="log_id").collect()}
    assert plain == salted and plain[1] == 2000 and plain[5000] is None


def test_keyword_mode_reads_response_time_as_epoch_ns(spark):
    """The name-only rule treats an integer response_time_ms as a time column
    (epoch nanoseconds: hour 0, day 1, Thursday=3) and drops the original;
    the typed rule keeps it as a numeric feature."""
    from loghawk.plans.preprocess import derive_features
    rows = [(i, "10.0.0.%d" % (i % 3), "2024-01-0%d 10:00:00" % (1 + i % 3), "curl/7", "/api/x", "GET", "{}", 200,
             100 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "log_id long, ip_address string, timestamp string, user_agent string, "
                                     "endpoint string, method string, parameters string, status_code int, "
                                     "response_time_ms long")
    kw, spec_kw = derive_features(df, role_mode="keyword")
    assert "response_time_ms" not in spec_kw.names
    r = kw.select("response_time_ms_hour", "response_time_ms_day", "response_time_ms_dayofweek").distinct().collect()
    assert [tuple(x) for x in r] == [(0, 1, 3)]
    typed, spec_t = derive_features(df, role_mode="typed")
    assert "response_time_ms" in spec_t.names and "response_time_ms_hour" not in spec_t.names


def test_csv_scan_keeps_malformed_lines(spark, tmp_path):
    from loghawk.sources.logs import RAW_LOG_SCHEMA, read_logs
    p = tmp_path / "log.csv"
    p.write_text("ip_address,timestamp,user_agent,endpoint,method,parameters,status_code,response_time_ms\n"
                 "1.2.3.4,2024-01-01 10:00:00,curl,/api/a,GET,{},200,12\n"
                 "5.6.7.8,2024-01-01 10:01:00,curl,/api/b,GET,{},not-a-number,13\n")
    df = read_logs(spark, str(p), RAW_LOG_SCHEMA, with_id="log_id").cache()
    rows = {r.ip_address: r for r in df.collect()}
    assert rows["1.2.3.4"].status_code == 200 and rows["1.2.3.4"]["_corrupt_record"] is None
    assert rows["5.6.7.8"].status_code is None and rows["5.6.7.8"]["_corrupt_record"] is not None
    assert df.select("log_id").distinct().count() == 2
    inferred = read_logs(spark, str(p))
    assert dict(inferred.dtypes)["response_time_ms"] in ("int", "bigint")


def test_zscore_rollup_stats_match_direct(spark):
    """The flagship's one-scan rollup statistics equal a direct computation,
    with NULL IPs counted as 0 requests and a hot IP."""
    import numpy as np
    import pandas as pd
    from loghawk.plans.preprocess import zscore_scored
    rows = []
    for i in range(300):
        ip = None if i % 17 == 0 else ("10.0.0.1" if i % 3 == 0 else f"10.0.{i % 5}.{i % 7}")
        rows.append((i, ip, dt.datetime(2024, 1, 1 + i % 9, i % 24, i % 60), "Mozilla Chrome" if i % 2 else None,
                     "/api/x", "GET", "{}", [200, 302, 404, 500][i % 4], float(i % 13)))
    log = spark.createDataFrame(rows, "log_id long, ip_address string, request_time timestamp_ntz, user_agent string,"
                                      " endpoint string, method string, parameters string, status_code int,"
                                      " response_ms double")
    got = {r.log_id: r.reconstruction_error for r in zscore_scored(log).collect()}
    pdf = pd.DataFrame(rows, columns=["log_id", "ip", "t", "ua", "ep", "m", "p", "status", "resp"])
    counts = pdf.groupby("ip").size()
    rpi = pdf["ip"].map(counts).fillna(0).to_numpy(float)
    z = (rpi - rpi.mean()) / rpi.std()
    # only the requests_per_ip term is checked: error minus all other terms is z^2 / 16
    from loghawk.plans.preprocess import ZSCORE_FEATURES
    assert len(got) == 300
    only_rpi = zscore_scored(log, features=["requests_per_ip"]).collect()
    by_id = {r.log_id: r.reconstruction_error for r in only_rpi}
    assert np.allclose([by_id[i] for i in pdf["log_id"]], z ** 2, atol=1e-9)
    assert len(ZSCORE_FEATURES) == 16


def test_flagship_on_empty_log(spark):
    from loghawk.plans.preprocess import zscore_scored
    from loghawk.sources.tables import api_log
    empty = api_log(spark, "/root/testdata/sf0.001").limit(0)
    assert zscore_scored(empty).count() == 0


def test_dotted_endpoint_names_flow_through(spark):
    """One-hot columns of endpoints with dots or slashes survive selection,
    filling, scaling and vectorising."""
    from loghawk.plans.detection import prepare
    rows = [(i, "10.0.0.%d" % (i % 4), dt.datetime(2024, 1, 1, i % 24), "curl", ["/api/v1.0/users", "/index.html"][i % 2],
             "GET", "{}", 200, float(i)) for i in range(40)]
    log = spark.createDataFrame(rows, "log_id long, ip_address string, request_time timestamp_ntz, user_agent string,"
                                      " endpoint string, method string, parameters string, status_code int,"
                                      " response_ms double")
    vec, spec, scaler = prepare(log)
    assert "endpoint_endpoint_/api/v1.0/users" in spec.names
    assert vec.count() == 40 and len(vec.first().features) == len(spec.names)


def test_profile_approx_close_to_exact(spark):
    from loghawk.sources.tables import api_log
    log = api_log(spark, "/root/testdata/sf0.01")
    exact = {r.column: r.distinct_values for r in PR.profile_columns(log).collect()}
    approx = {r.column: r.distinct_values for r in PR.profile_columns(log, approx=True, rsd=0.02).collect()}
    for c, v in exact.items():
        assert abs(approx[c] - v) <= max(2, 0.08 * v), (c, v, approx[c])


def test_partitioned_log_sink_prunes(spark, tmp_path):
    from loghawk.sources.logs import write_logs
    from loghawk.sources.tables import api_log
    log = api_log(spark, "/root/testdata/sf0.001").withColumn("day", F.to_date("request_time"))
    write_logs(log, str(tmp_path / "logs"), partition_by=["day"])
    back = spark.read.parquet(str(tmp_path / "logs"))
    one = back.where(F.col("day") == F.lit("2024-01-02").cast("date"))
    assert one.count() == log.where(F.col("day") == F.lit("2024-01-02").cast("date")).count() > 0
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        one.explain()
    plan = buf.getvalue()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_size_for_input_respects_existing_settings(spark):
    from loghawk.session import size_for_input
    keys = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64MB")        # set by the "cluster": kept
        done = size_for_input(spark, 100 * 1024 ** 4)
        assert done["spark.sql.shuffle.partitions"] == str(100 * 1024 ** 4 // (200 * 1024 ** 2))
        assert "spark.sql.files.maxPartitionBytes" not in done
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "64MB"
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
