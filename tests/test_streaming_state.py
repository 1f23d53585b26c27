"""State of the streams: totals that expire, windows that go under the watermark."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghawk.streaming import streams as ST
from loghawk.streaming.idle import expiring_ip_totals, merge_pieces

SCHEMA = "ip_address string, request_time timestamp"
START = dt.datetime(2024, 1, 1)


def totals(rows, gap):
    """[(ip, minute)] -> sorted [(ip, first, last, requests)]."""
    out = []
    for ip in sorted({i for i, _ in rows}):
        times = sorted(t for i, t in rows if i == ip)
        cut = [0] + [k for k in range(1, len(times)) if times[k] - times[k - 1] > gap] + [len(times)]
        out += [(ip, times[a], times[b - 1], b - a) for a, b in zip(cut, cut[1:])]
    return out


class Feed:
    """A stream over a folder that gets files one by one."""

    def __init__(self, spark, tmp_path, make):
        self.spark, self.make, self.base = spark, make, str(tmp_path)
        self.n = 0

    def add(self, rows):
        """Let (ip, minute) rows arrive; run to the end of them; state rows left."""
        made = [(ip, None if m is None else START + dt.timedelta(minutes=m)) for ip, m in rows]
        self.spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{self.base}/in/part-{self.n}")
        self.n += 1
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.base}/in/*")
        self.path, query = ST.run_to_table(self.make(stream), "feed", base=self.base)
        self.states = [[s["numRowsTotal"] for s in p["stateOperators"]] for p in query.recentProgress if p["stateOperators"]]
        return self.states[-1][0]

    def got(self):
        micros = [F.unix_micros(c) for c in ("first_request", "last_request")]
        base = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6
        rows = self.spark.read.parquet(self.path).select("ip_address", *[((m - base) / 60_000_000).cast("int") for m in micros], "requests")
        return sorted(tuple(r) for r in rows.collect())


def test_merge_pieces():
    rng = random.Random(1)
    for _ in range(300):
        times = [rng.randrange(200) for _ in range(rng.randrange(1, 30))]
        cut = [times[i::3] for i in range(3)]       # tasks put together what they have
        parts = [merge_pieces(np.array(c), np.array(c), np.ones(len(c), np.int64), 5) for c in cut if c]
        first, last, n = merge_pieces(*[np.concatenate(x) for x in zip(*parts)], 5)
        assert [(0, *x) for x in zip(first.tolist(), last.tolist(), n.tolist())] == totals([(0, t) for t in times], 5)


def test_totals_expire_and_their_state_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: expiring_ip_totals(s, gap="30 minutes", delay="10 minutes"))
    rng = random.Random(3)
    first = [(f"10.0.0.{i % 40}", rng.randrange(60)) for i in range(300)] + [(None, 5), ("10.0.0.1", None)]
    held = feed.add(first)
    assert held >= 40 and feed.got() == []
    # one IP goes on and joins its total, in any order; the others fall silent
    second = [("10.0.0.7", m) for m in (118, 95, 88, 61)]
    after = feed.add(second)
    assert after < held / 4, (held, after)
    on_time = [r for r in first if r[0] and r[1] is not None] + second
    want = [r for r in totals(on_time, 30)]
    assert feed.got() == [r for r in want if r[2] + 30 <= 108]
    # behind the watermark: late, not counted
    feed.add([("10.0.0.9", 20), ("late", 100)])
    # an open total is emitted once, after its last request
    last = feed.add([("far", 10_000)])
    assert feed.got() == want
    assert last <= 4


def test_an_open_total_joins_another(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: expiring_ip_totals(s, gap="30 minutes", delay="60 minutes"))
    feed.add([("a", 0), ("a", 50), ("b", 0)])
    feed.add([("a", 25)])
    feed.add([("far", 10_000)])
    assert feed.got() == [("a", 0, 50, 3), ("b", 0, 0, 1)]


@pytest.mark.parametrize("make", [ST.tumbling_counts, ST.sliding_counts, ST.session_counts])
def test_windows_go_with_a_short_delay(spark, tmp_path, make):
    """Parts in the order of time: state never holds more than the windows of one part,
    and between the parts only those within the delay."""
    feed = Feed(spark, tmp_path, lambda s: make(ST.with_watermark(s, delay="10 minutes")))
    parts = [[(f"10.0.0.{i % 20}", hour * 600 + i % 590) for i in range(400)] for hour in range(3)]
    one = 400 * (5 if make is ST.sliding_counts else 1)
    left = 0
    for part in parts:
        before, left = left, feed.add(part)
        assert left < one / 4, feed.states
        assert max(s[0] for s in feed.states) <= one + before
    feed.add([("far", 100_000)])
    rows = spark.read.parquet(feed.path)
    counted = rows.agg(F.sum("requests")).first()[0]
    assert counted == 1200 * (5 if make is ST.sliding_counts else 1)


def test_window_counts_joined_to_their_requests(spark, tmp_path):
    """Each request with its window's count, once; what the join and the count hold goes behind the watermark."""
    feed = Feed(spark, tmp_path, lambda s: ST.with_window_counts(s, delay="10 minutes"))
    rng = random.Random(5)
    parts = [[(f"10.0.0.{rng.randrange(4)}", hour * 300 + rng.randrange(290)) for _ in range(200)] for hour in range(3)]
    for part in parts:
        feed.add(part + [(None, part[0][1])])
        assert all(sum(s) < 100 for s in feed.states[-1:]), feed.states
    feed.add([("far", 100_000)])
    rows = [r for p in parts for r in p]
    want = {}
    for ip, m in rows:
        want[ip, m // 5] = want.get((ip, m // 5), 0) + 1
    got = spark.read.parquet(feed.path).select("ip_address", (F.unix_seconds("request_time") / 60).cast("long").alias("m"), "requests_in_window").collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) // 60
    assert sorted((r[0], r[1] - base, r[2]) for r in got if r[0]) == sorted((ip, m, want[ip, m // 5]) for ip, m in rows)
    assert [r[2] for r in got if r[0] is None] == [None] * 3


def test_scores_with_window_counts_equal_batch(spark, tmp_path):
    from loghawk.plans.detection import score_log, train_detector
    from loghawk.sources.tables import api_log

    from conftest import SF001
    log = api_log(spark, SF001)
    model, spec = train_detector(log, epochs=2, hidden=(8, 4), mode="window")
    assert "requests_per_ip_5min" in spec.names and "requests_per_ip" not in spec.names
    live = str(tmp_path / "live")
    spark.read.parquet(f"{SF001}/events.parquet").repartition(3).write.parquet(live + "/a")
    path = ST.score_with_window_counts(ST.log_stream(spark, live + "/*"), model, spec)
    got = {r.log_id: (round(r.reconstruction_error, 9), r.is_anomaly) for r in spark.read.parquet(path).collect()}
    want = {r.log_id: (round(r.reconstruction_error, 9), r.is_anomaly) for r in score_log(log, model, spec).collect()}
    # all windows but those still open
    assert set(got.items()) <= set(want.items()) and len(got) > 900


def test_stream_settings_come_back(spark):
    key = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    before = {k: spark.conf.get(k, None) for k in ST.STREAM_CONF}
    with ST.stream_settings(spark):
        assert spark.conf.get(key) == "true"
    assert {k: spark.conf.get(k, None) for k in ST.STREAM_CONF} == before
