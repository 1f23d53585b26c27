"""Streams equal batch; entry() smoke; every query/oracle key pairs up."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from loghawk.operators import aggregates as AG
from loghawk.sources.tables import api_log
from loghawk.streaming import streams as ST

from conftest import SF001


def test_stream_tumbling_equals_batch(spark):
    path, _ = ST.run_to_table(ST.tumbling_counts(ST.with_watermark(ST.log_stream(spark, SF001, "events.parquet"))), "t")
    stream = spark.read.parquet(path)
    wm = spark.read.parquet(f"{SF001}/events.parquet").agg(F.max("ts")).first()[0]
    import datetime as dt
    cut = wm - dt.timedelta(minutes=10)
    batch = AG.requests_per_ip_window(api_log(spark, SF001)).where(
        F.col("time_interval") + F.expr("INTERVAL 5 MINUTES") <= F.lit(cut))
    s = {(r.window_start.replace(tzinfo=None), r.ip_address, r.requests) for r in stream.collect()}
    b = {(r.time_interval, r.ip_address, r.requests_per_ip_5min) for r in batch.collect()}
    assert s == b and len(s) > 0


def test_running_totals_equal_batch(spark):
    path, _ = ST.run_to_table(ST.running_ip_totals(ST.log_stream(spark, SF001, "events.parquet")), "r", mode="update")
    got = {r.ip_address: r.requests_so_far for r in ST.latest_per_key(spark.read.parquet(path), ["ip_address"]).collect()}
    exp = {r.ip_address: r.requests_per_ip for r in AG.requests_per_ip(api_log(spark, SF001)).collect()}
    assert got == exp


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["log_id", "ip_address", "request_time", "status_code", "reconstruction_error",
                          "is_anomaly", "anomaly_score"]


def test_oracle_keys_are_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)


def test_stream_scoring_equals_batch(spark, tmp_path):
    """However the log is cut into batches: the counts are the reference log's."""
    from loghawk.plans.detection import score_log, train_detector
    log = api_log(spark, SF001)
    model, spec = train_detector(log, epochs=2, hidden=(8, 4))
    live = str(tmp_path / "live")
    spark.read.parquet(f"{SF001}/events.parquet").repartition(3).write.parquet(live)
    counts = AG.requests_per_ip(log), AG.requests_per_ip_window(log)
    path = ST.score_batches(ST.log_stream(spark, live, max_files_per_trigger=1), model, spec, counts)
    table = spark.read.parquet(path)
    assert table.select("batch_id").distinct().count() == 3
    got = {r.log_id: (round(r.reconstruction_error, 9), r.is_anomaly) for r in table.collect()}
    exp = {r.log_id: (round(r.reconstruction_error, 9), r.is_anomaly)
           for r in score_log(log, model, spec).collect()}
    assert got == exp and len(got) == 1000


def test_watermark_drops_late_rows(spark, tmp_path):
    """Rows arriving after the watermark passed their window are not counted."""
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    cut = ev.agg(F.percentile_approx("ts", 0.5)).first()[0]
    src = str(tmp_path / "src")
    ev.where(F.col("ts") >= F.lit(cut)).write.parquet(src + "/a")       # on time
    # the stream reads folder "live"; part a lands first, the late part b later
    import os
    os.makedirs(src + "/live")
    for f in os.listdir(src + "/a"):
        if f.endswith(".parquet"):
            os.link(os.path.join(src, "a", f), os.path.join(src, "live", "a-" + f))
    schema_src = ST.log_stream(spark, src + "/live", "*.parquet")
    q_df = ST.tumbling_counts(ST.with_watermark(schema_src))
    base = str(tmp_path / "out")
    w = (q_df.writeStream.option("checkpointLocation", base + "/ck").outputMode("append")
         .format("parquet").option("path", base + "/rows").trigger(availableNow=True))
    w.start().awaitTermination()
    first = spark.read.parquet(base + "/rows").count()
    ev.where(F.col("ts") < F.lit(cut)).write.parquet(src + "/b")         # late: hours behind the watermark
    for f in os.listdir(src + "/b"):
        if f.endswith(".parquet"):
            os.link(os.path.join(src, "b", f), os.path.join(src, "live", "b-" + f))
    w.start().awaitTermination()
    after = spark.read.parquet(base + "/rows")
    assert after.count() == first > 0
    assert after.agg(F.min("window_start")).first()[0].replace(tzinfo=None) >= cut.replace(second=0, microsecond=0) \
        - __import__("datetime").timedelta(minutes=5)
