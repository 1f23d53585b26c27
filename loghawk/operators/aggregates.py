"""Per-IP and per-IP-per-window request counts, joined back to the log.

Counts are hash aggregates with partial (map-side) aggregation, so a hot IP
is pre-combined in every task before the shuffle.  Joins back go through
``lookup_join`` (AQE's choice by bytes; skew splitting for hot IPs) instead of
a window ``count() over (partition by ip)``, which would put every row of a
hot IP into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.functions.columns import bucket_start
from loghawk.plans.joins import lookup_join


def requests_per_ip(df: DataFrame, ip: str = "ip_address", name: str = "requests_per_ip") -> DataFrame:
    """``(ip, requests_per_ip)``; NULL IPs are not a group."""
    return df.where(F.col(ip).isNotNull()).groupBy(ip).agg(F.count(F.lit(1)).alias(name))


def time_interval(df: DataFrame, ts: str, minutes: int = 5, name: str = "time_interval") -> DataFrame:
    """Floor the time to ``minutes``; NULL time stays NULL and the row stays."""
    return df.withColumn(name, bucket_start(ts, minutes))


def requests_per_ip_window(df: DataFrame, ip: str = "ip_address", ts: str = "request_time",
                           minutes: int = 5, name: str = "requests_per_ip_5min",
                           bucket: str = "time_interval") -> DataFrame:
    """``(ip, bucket, count)`` = a tumbling-window count per IP; NULL keys out."""
    b = bucket_start(ts, minutes)
    return (df.select(F.col(ip), b.alias(bucket))
            .where(F.col(ip).isNotNull() & F.col(bucket).isNotNull())
            .groupBy(ip, bucket).agg(F.count(F.lit(1)).alias(name)))


def with_requests_per_ip(df: DataFrame, ip: str = "ip_address", name: str = "requests_per_ip",
                         salt_buckets: int | None = None, id_col: str | None = None) -> DataFrame:
    """Every row gains its IP's count (NULL for a NULL IP, as the pandas merge).
    ``salt_buckets`` asks for a salted shuffle join."""
    return lookup_join(df, requests_per_ip(df, ip, name), ip, "left", salt_buckets, id_col)


def with_requests_per_ip_window(df: DataFrame, ip: str = "ip_address", ts: str = "request_time",
                                minutes: int = 5, name: str = "requests_per_ip_5min",
                                bucket: str = "time_interval",
                                salt_buckets: int | None = None, id_col: str | None = None) -> DataFrame:
    """Adds ``time_interval`` and the per-(IP, interval) count."""
    counts = requests_per_ip_window(df, ip, ts, minutes, name, bucket)
    return lookup_join(time_interval(df, ts, minutes, bucket), counts, [ip, bucket], "left",
                       salt_buckets, id_col)


def with_request_counts(df: DataFrame, ip: str = "ip_address", ts: str = "request_time", minutes: int = 5,
                        bucket: str = "time_interval", stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Both counts with ONE join of the log, or, with ``stored`` (the tables
    of ``requests_per_ip`` and ``requests_per_ip_window``), the counts of a
    reference log that travels with a model.

    The (ip, bucket) table is aggregated from the log once (partial agg); the
    per-IP totals are aggregated from it (never larger than the log) and attached; the log then joins it once on (ip, bucket) with NULL-safe bucket
    equality, so null-time rows still get their IP total while their window
    count stays NULL (pandas drops NaN group keys).
    """
    logged = time_interval(df, ts, minutes, bucket)
    if stored is not None:
        per_ip, per_bucket = stored
        return logged.join(per_ip, ip, "left").join(per_bucket, [ip, bucket], "left")
    per_bucket = (logged.where(F.col(ip).isNotNull()).groupBy(ip, bucket)
                  .agg(F.count(F.lit(1)).alias("__n")))
    per_ip = per_bucket.groupBy(ip).agg(F.sum("__n").alias("requests_per_ip"))
    table = (per_bucket.join(per_ip, ip)
             .select(F.col(ip).alias("__ip"), F.col(bucket).alias("__b"), "requests_per_ip",
                     F.when(F.col(bucket).isNotNull(), F.col("__n")).alias("requests_per_ip_5min")))
    joined = lookup_join(logged, table,
                         (F.col(ip) == F.col("__ip")) & F.col(bucket).eqNullSafe(F.col("__b")),
                         "left")
    return joined.drop("__ip", "__b")


def top_ips(df: DataFrame, ip: str = "ip_address", k: int = 20) -> DataFrame:
    """Top-k IPs by request count; ties by IP.  Partial agg + TakeOrdered (no full sort)."""
    return (requests_per_ip(df, ip, "requests").orderBy(F.desc("requests"), F.asc(ip)).limit(k))


def ip_summary(df: DataFrame, ip: str = "ip_address") -> DataFrame:
    """One row: unique IPs and mean requests per IP (two-level aggregate)."""
    return (requests_per_ip(df, ip, "n").agg(F.count(F.lit(1)).alias("unique_ips"),
                                             F.avg("n").alias("mean_requests_per_ip")))
