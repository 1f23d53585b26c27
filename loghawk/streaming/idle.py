"""Totals per IP that end when the IP falls silent (ST7).

A stateful operator on ``transformWithStateInPandas``: the state of an IP is its
open totals, each (first request, last request, requests), and one event-time
timer, that of the total that ends first.  A request within ``gap`` of an open total
goes into it, and may join two.  Once the watermark has passed ``gap`` behind a
total's last request, it is emitted and its state goes; one call of the timer emits all
that are over by then, so an IP's state is read and written once a batch however many
totals it has open.  An idle IP leaves nothing behind.

Requests are put together in each task before the shuffle (requests of one IP no
more than ``gap`` apart are one piece), so a hot IP's rows travel as a few pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: pandas has times from 1678 to 2261 only, in microseconds.
LATEST = 9_214_646_400_000_000
PIECE = "ip_address string, last_request timestamp, first_micros long, last_micros long, requests long"
TOTAL = "ip_address string, first_request timestamp, last_request timestamp, requests long"


def merge_pieces(first: np.ndarray, last: np.ndarray, requests: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that are no more than ``gap`` apart become one; sorted by first."""
    turn = np.lexsort((last, first))
    first, last, requests = first[turn], last[turn], requests[turn]
    reach = np.maximum.accumulate(last)
    begin = np.flatnonzero(np.append(True, first[1:] > reach[:-1] + gap)) if len(first) else np.empty(0, np.int64)
    if not len(begin):
        return first, last, requests
    return first[begin], np.maximum.reduceat(last, begin), np.add.reduceat(requests, begin)


def _pieces(gap: int, ip: str):
    """Of each batch of requests: the pieces of each IP."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ips = batch.column(ip).dictionary_encode()
            code = ips.indices.to_numpy().astype(np.int64)
            time = batch.column("micros").to_numpy()
            turn = np.lexsort((time, code))
            code, time = code[turn], time[turn]
            begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (time[1:] - time[:-1] > gap))) if len(code) else code
            end = np.append(begin[1:], len(code)) - 1 if len(begin) else begin
            last = time[end]
            yield pa.RecordBatch.from_arrays([
                ips.dictionary.take(pa.array(code[begin])), pa.array(last, pa.timestamp("us", "UTC")), pa.array(time[begin]), pa.array(last),
                pa.array((end - begin + 1).astype(np.int64))], ["ip_address", "last_request", "first_micros", "last_micros", "requests"])

    return run


class IdleTotals(StatefulProcessor):
    """Open totals of an IP, emitted when it was idle for longer than ``gap`` microseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "totals binary")      # first, last, requests: 64-bit numbers

    def _timer(self, last: int) -> int:
        """Milliseconds from which no request on time can belong to it any more."""
        return -(-(int(last) + self.gap) // 1000)

    def _load(self) -> np.ndarray:
        held = self.open.get()
        return np.frombuffer(held[0] if held else b"", np.int64).reshape(3, -1)

    def _keep(self, first: np.ndarray, last: np.ndarray, requests: np.ndarray) -> None:
        self.open.update((np.concatenate([first, last, requests]).astype(np.int64).tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self._load()
        new = [old, *(pdf[["first_micros", "last_micros", "requests"]].to_numpy(np.int64).T for pdf in rows)]
        first, last, requests = merge_pieces(*np.concatenate(new, axis=1), self.gap)
        self._retime(old[1], last)
        self._keep(first, last, requests)
        yield self._rows(key, np.empty((3, 0), np.int64))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._load()
        # all that the watermark has passed, not only the one that the timer was for
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        done = held[1] + self.gap <= now * 1000
        left = held[:, ~done]
        self._retime(np.empty(0, np.int64), left[1])
        if left.shape[1]:
            self._keep(*left)
        else:
            self.open.clear()
        yield self._rows(key, held[:, done])

    def _retime(self, before: np.ndarray, after: np.ndarray) -> None:
        """Move the timer from the total of ``before`` that ends first to that of ``after``."""
        old, new = (self._timer(x.min()) if len(x) else None for x in (before, after))
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if new is not None:
            self.handle.registerTimer(new)

    @staticmethod
    def _rows(key, totals: np.ndarray) -> pd.DataFrame:
        first, last, requests = totals
        return pd.DataFrame({"ip_address": pd.Series([key[0]] * len(first), dtype=object), "first_request": pd.to_datetime(first, unit="us", utc=True),
                             "last_request": pd.to_datetime(last, unit="us", utc=True), "requests": requests.astype(np.int64)})

    def close(self) -> None:
        pass


def expiring_ip_totals(df: DataFrame, ip: str = "ip_address", ts: str = "request_time", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """ST7: (ip_address, first_request, last_request, requests) of each stretch in
    which an IP is never idle for longer than ``gap`` (append mode).  Requests
    without an IP or a time (from 1678 to 2261) don't count; requests more than
    ``delay`` behind are late."""
    spark = df.sparkSession
    micros = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {gap}"))).first()[0]
    rows = df.where(F.col(ip).isNotNull()).select(F.col(ip).cast("string").alias("ip_address"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    rows = rows.where(F.abs("micros") <= LATEST)
    pieces = rows.mapInArrow(_pieces(micros, "ip_address"), PIECE).withWatermark("last_request", delay)
    return pieces.groupBy("ip_address").transformWithStateInPandas(IdleTotals(micros), TOTAL, outputMode="Append", timeMode="EventTime")
