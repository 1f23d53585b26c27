"""Streaming log analytics: file-folder source, event-time watermark,
tumbling / sliding / session windows, running per-IP totals and stream
scoring with a stored model.

All state is bounded by the watermark (append mode): windows, sessions and the
totals of ``expiring_ip_totals`` go once it has passed them.  Only
``running_ip_totals`` keeps one row per IP for good.  Sinks write to the shared
checkpoint folder, a folder for each micro-batch where they go through
``foreachBatch``, so a repeated batch replaces its own rows; nothing is
collected by the driver.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loghawk.session import scratch_path
from loghawk.sources.tables import events_to_api_log


def log_stream(spark: SparkSession, folder: str, file_glob: str = "*.parquet",
               max_files_per_trigger: int | None = None, schema=None) -> DataFrame:
    """ST1: the ``api_log`` projection over a folder (or glob of folders) of
    ``events`` Parquet files; new files are picked up as they land.  The event
    time is cast to TIMESTAMP (watermarks need it; the session time zone is UTC)."""
    schema = schema or spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(folder)
    return events_to_api_log(ev).withColumn("request_time", F.col("request_time").cast("timestamp"))


def with_watermark(df: DataFrame, ts: str = "request_time", delay: str = "10 minutes") -> DataFrame:
    """ST2: rows later than ``delay`` behind the max event time seen are dropped
    from stateful operators, and window state older than it is evicted."""
    return df.withWatermark(ts, delay)


def tumbling_counts(df: DataFrame, ip: str = "ip_address", ts: str = "request_time",
                    size: str = "5 minutes") -> DataFrame:
    """ST3: requests per IP per tumbling window."""
    return (df.where(F.col(ip).isNotNull()).groupBy(F.window(ts, size).alias("w"), ip)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), ip, "requests"))


def sliding_counts(df: DataFrame, ip: str = "ip_address", ts: str = "request_time", size: str = "5 minutes",
                   slide: str = "1 minute") -> DataFrame:
    """ST4: requests per IP per sliding window."""
    return (df.where(F.col(ip).isNotNull()).groupBy(F.window(ts, size, slide).alias("w"), ip)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), ip, "requests"))


def session_counts(df: DataFrame, ip: str = "ip_address", ts: str = "request_time", gap: str = "30 minutes") -> DataFrame:
    """ST5: per-IP sessions (a gap of ``gap`` closes a session).  Started by
    ``run_to_table``, sessions are merged in each task before the shuffle, so a
    hot IP's rows travel as sessions."""
    return (df.where(F.col(ip).isNotNull()).groupBy(F.session_window(ts, gap).alias("s"), ip)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), ip, "requests"))


def running_ip_totals(df: DataFrame, ip: str = "ip_address") -> DataFrame:
    """ST7: running requests per IP (update mode; state = one row per IP)."""
    return df.where(F.col(ip).isNotNull()).groupBy(ip).agg(F.count(F.lit(1)).alias("requests_so_far"))


#: Settings that a stream here is started with; they hold for its own queries only.
STREAM_CONF = {
    # sessions are merged before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # state off the heap; ``transformWithState`` has no other store
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


@contextmanager
def stream_settings(spark: SparkSession):
    """``STREAM_CONF`` while a query is started (it takes a copy of the session);
    the session's own values come back."""
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(df: DataFrame, name: str, mode: str = "append", available_now: bool = True,
                 processing_time: str | None = None, base: str | None = None) -> tuple[str, StreamingQuery]:
    """Start a stream writing Parquet under ``base`` (a folder of its own under
    the checkpoint folder by default; give the same one to go on later).
    Append mode writes rows directly; update mode goes through
    ``foreachBatch``: each micro-batch's changed rows are a folder
    ``batch_id=n``, so the latest row per key is the current value.  Returns
    (path, query)."""
    base = base or scratch_path(df.sparkSession, f"stream-{name}-{uuid.uuid4().hex[:8]}")
    out, ck = base + "/out", base + "/checkpoint"
    w = df.writeStream.option("checkpointLocation", ck).outputMode(mode)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    if mode == "append":
        w = w.format("parquet").option("path", out)
    else:
        def sink(batch: DataFrame, batch_id: int):
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        w = w.foreachBatch(sink)
    with stream_settings(df.sparkSession):
        q = w.start()
    if available_now:
        q.awaitTermination()
    return out, q


def latest_per_key(table: DataFrame, keys: list[str]) -> DataFrame:
    """Current value per key from an update-mode table (max batch id wins)."""
    latest = table.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return table.join(latest, keys + ["batch_id"]).drop("batch_id")


def score_batches(df: DataFrame, model, spec, counts: tuple[DataFrame, DataFrame], name: str = "scored", base: str | None = None) -> str:
    """ST6: score each micro-batch with a stored model, feature contract and
    scaler (no re-fitting on the stream).  The request counts are those of a
    reference log: ``counts``, the stored tables of ``requests_per_ip`` and
    ``requests_per_ip_window``, which travel with the model.  So a row's score
    doesn't depend on the batch that it comes in.  Returns the output path,
    with a folder for each micro-batch."""
    from loghawk.plans.detection import score_log
    spark = df.sparkSession
    base = base or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:8]}")
    out = base + "/out"

    def sink(batch: DataFrame, batch_id: int):
        scored = score_log(batch.withColumn("request_time", F.col("request_time").cast("timestamp_ntz")), model, spec, stored_counts=counts)
        scored.select("log_id", "ip_address", "reconstruction_error", "is_anomaly", "anomaly_score") \
            .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = df.writeStream.option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True) \
        .foreachBatch(sink).start()
    q.awaitTermination()
    return out


def with_window_counts(df: DataFrame, ip: str = "ip_address", ts: str = "request_time", size: str = "5 minutes",
                       delay: str = "10 minutes", out: str = "requests_in_window") -> DataFrame:
    """Every request with its IP's count in its window, once the watermark has
    closed the window (append mode).

    Two stateful operators in a chain: the windowed count, and a join of the
    requests with it on (IP, start of the window), so that a request meets its own
    count only, however many windows its IP has.  Both drop their state behind the
    watermark, and no stored table is read.  Requests without an IP pass by with a NULL count;
    those without a time belong to no window and have none either."""
    rows = df.withWatermark(ts, delay)
    lone = rows.where(F.col(ip).isNull() | F.col(ts).isNull()).withColumn(out, F.lit(None).cast("long"))
    rows = rows.where(F.col(ip).isNotNull() & F.col(ts).isNotNull())
    counts = rows.groupBy(F.window(ts, size).alias("__w"), F.col(ip).alias("__ip")).agg(F.count(F.lit(1)).alias(out))
    counts = counts.select("__ip", out, F.unix_micros("__w.start").alias("__start"), F.window_time("__w").alias("__last"))
    micros, length = F.unix_micros(F.col(ts).cast("timestamp")), F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {size}"))
    # the last moment of its window is a count's event time; the bounds let both sides' state go
    inside = (F.col(ts) <= F.col("__last")) & (F.col(ts) > F.col("__last") - F.expr(f"INTERVAL {size}"))
    met = rows.join(counts, (F.col(ip) == F.col("__ip")) & (micros - F.pmod(micros, length) == F.col("__start")) & inside)
    return met.select(*df.columns, out).unionByName(lone)


def score_with_window_counts(df: DataFrame, model, spec, name: str = "windowed", base: str | None = None, delay: str = "10 minutes") -> str:
    """ST6 with counts that the stream keeps itself: a model of the 'window' contract
    scores each request once its window has closed; row for row the batch
    score.  Returns the output path, with a folder for each micro-batch."""
    from loghawk.plans.detection import score_log
    from loghawk.plans.preprocess import COUNTED
    spark = df.sparkSession
    base = base or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:8]}")
    out = base + "/out"

    def sink(batch: DataFrame, batch_id: int):
        scored = score_log(batch.withColumn("request_time", F.col("request_time").cast("timestamp_ntz")), model, spec)
        scored.select("log_id", "ip_address", "reconstruction_error", "is_anomaly", "anomaly_score").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    counted = with_window_counts(df, delay=delay, out=COUNTED)
    with stream_settings(spark):
        q = counted.writeStream.option("checkpointLocation", base + "/checkpoint").outputMode("append").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return out
