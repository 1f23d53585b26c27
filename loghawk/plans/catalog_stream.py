"""Registered streaming queries.  The ``events`` arrive in parts,
earliest first; the stream runs to the end of each part (availableNow) and goes
on from its checkpoint with the next.  A closing marker then delivers the
windows that are still open, so the results are those of the whole log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loghawk.operators import aggregates as AG
from loghawk.plans.catalog_model import fixed_detector, fixed_sql, fixed_window_detector, fixed_window_sql
from loghawk.plans.registry import finish, register, sql_finish
from loghawk.session import cut_lineage, scratch_path
from loghawk.sources.tables import api_log, read_table
from loghawk.streaming import streams as ST
from loghawk.streaming.idle import expiring_ip_totals

PARTS = 3


def _close(spark, folder: str, schema) -> None:
    """Write the closing marker of a finished log to one of the stream's
    folders: an event of user -1 in the far future.  It moves the watermark past
    every window of the log, so the next run emits what is still open; its own
    window never closes.  (It needs an IP: a filter on it runs before the
    watermark.)"""
    made = {"ts": F.to_timestamp(F.lit("2200-01-01")), "user_id": F.lit(-1)}
    end = spark.range(1).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    end.write.mode("overwrite").parquet(folder)


def _parts(spark, sf, name, order=tuple(range(PARTS)), close=True):
    """Let the parts of ``events`` arrive in ``order``, then the closing
    marker; yields (the folder of this stream, the log stream) after each."""
    events = read_table(spark, sf, "events")
    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:8]}")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(micros), F.max(micros)).first()
    mine = F.least(F.floor((micros - lo) / (hi - lo) * PARTS), F.lit(PARTS - 1))
    for n, part in enumerate([*order, *([None] if close else [])]):
        if part is None:
            _close(spark, f"{base}/in/part-{n}", events.schema)
        else:
            events.where(mine == part).write.parquet(f"{base}/in/part-{n}")
        yield base, ST.log_stream(spark, f"{base}/in/*", schema=events.schema)


def _replay(spark, sf, name, make, mode="append", **how):
    """Run ``make(log stream)`` as the parts arrive; the sink's path."""
    for base, log in _parts(spark, sf, name, **how):
        path, _ = ST.run_to_table(make(log), name, mode, base=base)
    return path


def _late(df, delay="10 minutes"):
    return ST.with_watermark(df, delay=delay)


def _ip(ev="ev"):
    return f"concat('10.', CAST({ev}.user_id % 16 AS VARCHAR), '.0.', CAST({ev}.user_id % 250 AS VARCHAR))"


@register("stream_tumbling_counts", sql_finish(
    f"SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,"
    f" time_bucket(INTERVAL '5 minutes', ts) + INTERVAL 5 MINUTE AS window_end, {_ip()} AS ip_address,"
    f" count(*) AS requests FROM events ev GROUP BY 1, 2, 3",
    times=["window_start", "window_end"], others=["ip_address", "requests"]))
def q_tumbling(spark, sf):
    """Append mode: a window is emitted once the watermark passes its end.  The
    parts come in the order of time, so a delay of minutes is enough, and state
    holds the windows of one part at most."""
    path = _replay(spark, sf, "tumbling", lambda df: ST.tumbling_counts(_late(df)))
    return finish(spark.read.parquet(path))


@register("stream_late_rows", sql_finish(
    "WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events), p AS (SELECT ev.*, least(floor((epoch_us(ts) - epoch_us(lo)) / CAST(epoch_us(hi) - epoch_us(lo) AS DOUBLE) * 3), 2) AS part FROM events ev, b)"
    " SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start,"
    f" time_bucket(INTERVAL '5 minutes', ts) + INTERVAL 5 MINUTE AS window_end, {_ip('p')} AS ip_address,"
    " count(*) AS requests FROM p WHERE part <> 1 OR time_bucket(INTERVAL '5 minutes', ts) + INTERVAL 5 MINUTE > (SELECT max(ts) FROM p WHERE part = 2) - INTERVAL 10 MINUTE GROUP BY 1, 2, 3",
    times=["window_start", "window_end"], others=["ip_address", "requests"]))
def q_late(spark, sf):
    """The middle part comes last, behind the watermark: its rows are late and
    don't count."""
    path = _replay(spark, sf, "late", lambda df: ST.tumbling_counts(_late(df)), order=(0, 2, 1))
    return finish(spark.read.parquet(path))


@register("stream_sliding_counts", sql_finish(
    f"WITH w AS (SELECT time_bucket(INTERVAL '1 minute', ts) - to_minutes(k) AS window_start, {_ip()} AS ip_address"
    " FROM events ev, unnest(range(5)) AS t(k))"
    " SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, ip_address, count(*) AS requests"
    f" FROM w GROUP BY 1, 2, 3",
    times=["window_start", "window_end"], others=["ip_address", "requests"]))
def q_sliding(spark, sf):
    path = _replay(spark, sf, "sliding", lambda df: ST.sliding_counts(_late(df)))
    return finish(spark.read.parquet(path))


@register("stream_session_counts", sql_finish(
    f"WITH l AS (SELECT {_ip()} AS ip_address, ts, lag(ts) OVER (PARTITION BY {_ip()} ORDER BY ts) AS prev FROM events ev)"
    ", n AS (SELECT *, CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM l)"
    ", s AS (SELECT *, sum(new) OVER (PARTITION BY ip_address ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM n)"
    " SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, ip_address, count(*) AS requests"
    f" FROM s GROUP BY ip_address, sid",
    times=["session_start", "session_end"], others=["ip_address", "requests"]))
def q_sessions(spark, sf):
    path = _replay(spark, sf, "sessions", lambda df: ST.session_counts(_late(df)))
    return finish(spark.read.parquet(path))


@register("stream_running_ip_totals", f"SELECT {_ip()} AS ip_address, count(*) AS requests_so_far FROM events ev GROUP BY 1")
def q_running(spark, sf):
    path = _replay(spark, sf, "running", ST.running_ip_totals, "update", close=False)
    return ST.latest_per_key(spark.read.parquet(path), ["ip_address"])


@register("stream_running_ip_expiring", sql_finish(
    f"WITH l AS (SELECT {_ip()} AS ip_address, ts, lag(ts) OVER (PARTITION BY {_ip()} ORDER BY ts) AS prev FROM events ev)"
    ", s AS (SELECT ip_address, ts, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)"
    " OVER (PARTITION BY ip_address ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)"
    " SELECT ip_address, min(ts) AS first_request, max(ts) AS last_request, count(*) AS requests FROM s GROUP BY ip_address, sid",
    times=["first_request", "last_request"], others=["ip_address", "requests"]))
def q_expiring(spark, sf):
    """An IP's total is emitted once it was idle for more than 30 minutes, and its state goes."""
    path = _replay(spark, sf, "expiring", expiring_ip_totals)
    return finish(spark.read.parquet(path))


@register("stream_scoring")
def q_stream_scoring(spark, sf):
    """Score the stream with the autoencoder trained on the same log and with its counts."""
    from loghawk.plans.detection import train_detector
    log = api_log(spark, sf)
    model, spec = train_detector(log, epochs=50)
    counts = cut_lineage(AG.requests_per_ip(log)), cut_lineage(AG.requests_per_ip_window(log))
    path = ST.score_batches(ST.log_stream(spark, sf, "events.parquet"), model, spec, counts)
    return spark.read.parquet(path).drop("batch_id")


@register("stream_scoring_fixed_weights", sql_finish(fixed_sql("log_id, ip_address, reconstruction_error, is_anomaly, anomaly_score"),
                                                     doubles=["reconstruction_error", "anomaly_score"], others=["log_id", "ip_address", "is_anomaly"]))
def q_stream_scoring_fixed(spark, sf):
    """A network with given weights over several batches: row for row the batch score."""
    model, spec = fixed_detector()
    log = api_log(spark, sf)
    counts = cut_lineage(AG.requests_per_ip(log)), cut_lineage(AG.requests_per_ip_window(log))
    for base, stream in _parts(spark, sf, "fixed", close=False):
        path = ST.score_batches(stream, model, spec, counts, base=base)
    return finish(spark.read.parquet(path).drop("batch_id"))


@register("stream_scoring_window_counts", sql_finish(fixed_window_sql("log_id, ip_address, reconstruction_error, is_anomaly, anomaly_score"),
                                                     doubles=["reconstruction_error", "anomaly_score"], others=["log_id", "ip_address", "is_anomaly"]))
def q_stream_scoring_windows(spark, sf):
    """Counts kept by the stream: windowed counts joined to the requests under the
    watermark, then a network with given weights; row for row the batch score."""
    model, spec = fixed_window_detector()
    for base, stream in _parts(spark, sf, "windowed"):
        path = ST.score_with_window_counts(stream, model, spec, base=base)
    return finish(spark.read.parquet(path).drop("batch_id"))
