"""Periodic run detection by internal pattern matching (operator 12).

A run of smallest period q and at least 3 * q words holds a whole dyadic block
(2**k words from a multiple of 2**k on, 2**k <= q < 2**(k + 1)) whose copy q words
on is inside the run as well.  So each block asks for its occurrences in the
window beside it, from 2**k to 2**(k + 1) - 1 words on: successors of a place among
the block's interval of the suffix array, answered by a wavelet tree over that
array.  The occurrences of a block in a window no longer than itself form one
arithmetic progression.  One or two of them are candidate periods by their
distance.  Three or more mean that the block itself is periodic, by the progression's
difference; then a longer period must match the begins or the ends of the two
stretches of that difference, which gives two candidates.  Periods under
eight, whose runs have 24 words at least, are asked for by blocks of eight.

Each candidate is extended both ways by comparing dyadic blocks (their classes
from the prefix doubling that builds the suffix array), and kept when the stretch is
long enough.  Of the periods found for a stretch the smallest is its run's.

Documents are independent: Spark deals them out, and a task works on about
``CHUNK_WORDS`` words of whole documents at a time, as one text with an own separator
behind each document.  A longer document is a chunk by itself.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.llm.common import utf8

SHORTEST = 24
#: Least exponent: periods that a run holds.
TIMES = 3
#: The smallest blocks have 2**BASE words; a run of SHORTEST words holds one and its copy.
BASE = 3
CHUNK_WORDS = 1 << 19


def classes(text: np.ndarray, deepest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, classes) by prefix doubling, as deep as 2**deepest words.

    ``classes[k][i]``: the first place in the suffix array of the suffixes that
    share the 2**k words from i on, so places of a class are an interval.  The
    list ends early where all suffixes differ.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, size = [rank.astype(np.int32)], 1
    while len(levels) <= deepest:
        if size == 1:
            member = np.arange(n)
        else:       # only members of classes of two and more move, each within its class
            place = np.arange(n)
            head = rank[order]
            member = np.flatnonzero((np.append(head[1:] == head[:-1], False)) | (head != place))
        if not len(member):
            break
        own = order[member]
        behind = own + size
        last = behind >= n
        second = np.where(last, -1, rank[np.minimum(behind, n - 1)])
        turn = np.argsort(rank[own] * (n + 1) + second + 1, kind="stable")
        own, second = own[turn], second[turn]
        order[member] = own
        head = rank[own]
        new = np.append(True, (head[1:] != head[:-1]) | (second[1:] != second[:-1]))
        rank[own] = member[np.flatnonzero(new)][np.cumsum(new) - 1]
        size *= 2
        levels.append(rank.astype(np.int32))
    return order, levels


class WaveletTree:
    """Counts and selects by value within intervals of an array of numbers, for
    many questions at once.  A level for each bit, the zeros of a level first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []     # zeros before a place, by level
        for b in reversed(range(self.bits)):
            one = (values >> b) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def smaller(self, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values of each interval [lo, hi) are smaller."""
        count = np.zeros(len(lo), np.int64)
        for b, before in zip(reversed(range(self.bits)), self.zeros):
            zl, zh = before[lo], before[hi]
            one = (than >> b) & 1 == 1
            count += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, before[-1] + lo - zl, zl), np.where(one, before[-1] + hi - zh, zh)
        return count

    def select(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest value (from 0) of each interval; nth is inside."""
        value = np.zeros(len(lo), np.int64)
        for b, before in zip(reversed(range(self.bits)), self.zeros):
            zl, zh = before[lo], before[hi]
            one = nth >= zh - zl
            nth = np.where(one, nth - (zh - zl), nth)
            value += one.astype(np.int64) << b
            lo, hi = np.where(one, before[-1] + lo - zl, zl), np.where(one, before[-1] + hi - zh, zh)
        return value


def _extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words before and from the places a < b on."""
    n = len(levels[0])
    on, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    top = len(levels) - 1
    steps = list(range(top, -1, -1))
    for k in steps:
        size, cls = 1 << k, levels[k]
        live = np.arange(len(a))
        while len(live):        # below the top, once is enough
            x, y = a[live] + on[live], b[live] + on[live]
            ok = y + size <= n
            ok[ok] = cls[x[ok]] == cls[y[ok]]
            live = live[ok]
            on[live] += size
            if k < top:
                break
        live = np.arange(len(a))
        while len(live):
            x, y = a[live] - back[live] - size, b[live] - back[live] - size
            ok = x >= 0
            ok[ok] = cls[x[ok]] == cls[y[ok]]
            live = live[ok]
            back[live] += size
            if k < top:
                break
    return back, on


def _candidates(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of blocks and their occurrences that may be a period."""
    n = len(order)
    tree = None
    places, gaps = [], []
    for k in range(BASE, len(levels)):
        size, cls = 1 << k, levels[k]
        count = np.bincount(cls, minlength=n)
        i = np.arange(0, n - size + 1, size)
        i = i[count[cls[i]] > 1]
        if not len(i):
            continue
        if tree is None:
            tree = WaveletTree(order)
        lo = cls[i].astype(np.int64)
        hi = lo + count[lo]
        # windows beside the block; the smallest blocks ask the nearer one as well
        for nearest, farthest in [(1, size - 1)] * (k == BASE) + [(size, 2 * size - 1)]:
            at = tree.smaller(lo, hi, np.minimum(i + nearest, n - 1))
            found = np.full((3, len(i)), n, np.int64)       # the first three occurrences
            for j in range(3):
                inside = np.flatnonzero(at + j < hi - lo)
                o = tree.select(lo[inside], hi[inside], at[inside] + j)
                near = (o >= i[inside] + nearest) & (o <= i[inside] + farthest)
                found[j, inside[near]] = o[near]
            for j in range(2):
                some = found[j] < n
                places.append(i[some])
                gaps.append((found[j] - i)[some])
            many = np.flatnonzero(found[2] < n)
            if len(many):
                here, there = i[many], found[0, many]
                step = found[1, many] - there
                back, on = _extend(levels, here, here + step)
                back2, on2 = _extend(levels, there, there + step)
                for d in ((there - back2) - (here - back), (there + on2) - (here + on)):
                    some = (d >= nearest) & (d <= farthest)
                    places.append(here[some])
                    gaps.append(d[some])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(gaps)


def runs_of(text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a text of word numbers, by start.
    ``longest``: words of the longest document in it."""
    none = (np.empty(0, np.int64),) * 3
    if longest < SHORTEST:
        return none
    order, levels = classes(text, max(BASE, (longest // TIMES).bit_length() - 1))
    place, gap = _candidates(order, levels)
    if not len(place):
        return none
    seen = np.unique(place * (len(text) + 1) + gap)
    place, gap = seen // (len(text) + 1), seen % (len(text) + 1)
    back, on = _extend(levels, place, place + gap)
    start, end = place - back, place + gap + on
    long = end - start >= np.maximum(SHORTEST, TIMES * gap)
    start, end, gap = start[long], end[long], gap[long]
    turn = np.lexsort((gap, end, start))
    start, end, gap = start[turn], end[turn], gap[turn]
    least = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.empty(0, bool)
    start, end, gap = start[least], end[least], gap[least]
    turn = np.lexsort((gap, start))
    return start[turn], end[turn], gap[turn]


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a document whose tail is made periodic: where the CRC-32 of
    the decimal id is a multiple of 10, words from a on repeat p words."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


class _Chunk:
    """Whole documents whose runs are found at once."""

    def __init__(self, tail):
        self.tail = tail
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []      # (doc_id, words, numbers of the words taken)
        self.size = 0

    def add(self, doc_id, raw: bytes) -> None:
        words = raw.split()      # at space and tab .. carriage return
        number = self.number
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        at = self.tail(doc_id, len(words))
        if at is not None:
            ids = ids[at]
        self.docs.append((doc_id, words, at))
        self.parts.append(ids)
        self.size += len(ids) + 1

    def results(self) -> pa.RecordBatch:
        lens = np.array([len(x) for x in self.parts])
        # each document is followed by a separator that is found nowhere else
        ends = np.cumsum(lens + 1) - 1
        text = np.empty(self.size, np.int64)
        inside = np.ones(self.size, bool)
        inside[ends] = False
        text[inside] = np.concatenate(self.parts)
        text[ends] = len(self.number) + np.arange(len(ends))
        start, end, period = runs_of(text, int(lens.max()))
        of = np.searchsorted(ends, start)
        bounds = np.searchsorted(of, np.arange(len(ends) + 1)).tolist()
        rows = []
        for d, (doc_id, words, at) in enumerate(self.docs):
            if at is not None:
                words = [words[i] for i in at.tolist()]
            base = int(ends[d] - lens[d])
            lo, hi = bounds[d], bounds[d + 1]
            rows.append((doc_id, *_report(words, (start[lo:hi] - base).tolist(), (end[lo:hi] - base).tolist(), period[lo:hi].tolist())))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], NAMES)


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _report(words: list[bytes], starts: list[int], ends: list[int], periods: list[int]) -> tuple:
    best: tuple = (None,) * 4
    if starts:
        _, s, q, e = min((-Fraction(e - s, q), s, q, e) for s, e, q in zip(starts, ends, periods))
        best = (s, e - s, q, 1000 * (e - s) // q)
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, np.array(starts) + np.array(periods), 1)
        np.add.at(steps, ends, -1)
        words = [w for w, c in zip(words, np.cumsum(steps).tolist()) if not c]
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in zip(starts, ends, periods))
    return (len(starts), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def _find(tail, chunk_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(tail)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), utf8(part.column("text"))):
                    chunk.add(doc_id, raw)
                    if chunk.size >= chunk_words:
                        yield chunk.results()
        if chunk.docs:
            yield chunk.results()

    return run


def no_tail(doc_id, n: int) -> None:
    """The words as they stand."""


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail=no_tail, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256), one row for each input row.

    A run is a stretch of words with smallest period q that is 24 words and
    3 * q at least and can't be extended.  The four columns tell of the run
    with the greatest length / period (ties: smallest start, then period) and are
    null without one.  ``tail(doc_id, n)`` may name the words that stand for
    those of the text.  Null and empty texts have no words and no run, and the
    hashes are those of the empty string.  Rows that repeat an id, and null ids, are
    judged by themselves; with ``repeated_tail`` a null id changes no word.
    Extra columns are ignored.  A task holds a chunk of documents, or one longer one.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_find(tail, chunk_words), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
