"""Skew experiment: a 10x log derived from sf0.1 events where one IP holds a
third of all rows; runs the per-IP count join (shuffle path forced) and the
per-IP sequential edges, then prints per-stage task balance read from Spark's
event log (written to a fresh scratch folder; the UI stays off).

Usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

import zstandard

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F  # noqa: E402

from loghawk.operators import aggregates as AG  # noqa: E402
from loghawk.operators import graph as GR  # noqa: E402
from loghawk.session import build_session  # noqa: E402
from loghawk.sources.tables import api_log  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="skew-")
    spark = build_session("local[8]", 32, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB"})
    base = api_log(spark, sf)
    big = (base.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
           .withColumn("log_id", F.col("log_id") + F.col("k") * 1_000_000).drop("k"))
    big = big.withColumn("ip_address", F.when(F.col("log_id") % 3 == 0, F.lit("10.0.0.1"))
                         .otherwise(F.col("ip_address"))).repartition(16)
    t = time.time()
    AG.with_request_counts(big).write.format("noop").mode("overwrite").save()
    print("request counts (shuffle join):", round(time.time() - t, 1), "s")
    t = time.time()
    GR.sequential_edges(big, ["request_time", "log_id"], partition=["ip_address"]).write.format("noop") \
        .mode("overwrite").save()
    print("sequential edges per IP:", round(time.time() - t, 1), "s")
    spark.stop()
    stages: dict[int, list[tuple[int, int]]] = {}
    for f in sorted(glob.glob(os.path.join(logdir, "*", "events_*"))):
        with open(f, "rb") as fh:
            data = zstandard.ZstdDecompressor().stream_reader(fh).read()
        for line in data.decode().splitlines():
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd":
                ti, m = e["Task Info"], e.get("Task Metrics") or {}
                rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                stages.setdefault(e["Stage ID"], []).append((ti["Finish Time"] - ti["Launch Time"], rec))
    for sid, ts in sorted(stages.items()):
        recs = [r for _, r in ts]
        if len(ts) > 1 and max(recs) > 0:
            print(f"stage {sid}: {len(ts)} tasks, shuffle records max {max(recs)} median "
                  f"{int(statistics.median(recs))}, max task {max(t for t, _ in ts)} ms")


if __name__ == "__main__":
    main()
