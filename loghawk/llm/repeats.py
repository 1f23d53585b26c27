"""Removal of repeated byte strings (operator 6).

The wanted equal strings of ``length`` bytes are the intervals of a suffix
array whose common prefix reaches ``length``.  They are found by interval
expansion on a Burrows-Wheeler transform: all suffixes start as one interval,
and each round of backward extension by one byte splits the intervals, so that
common prefixes come by increasing value; it stops at ``length``.

One transform of the whole corpus would not be distributed, so the text is
first dealt out such that equal strings meet.  Every window of ``length``
bytes has one anchor, the least hash of its grams of ``GRAM`` bytes, the
leftmost if tied; equal windows have equal anchors at the same place.  The
windows of an anchor are one stretch of text, known by its hash.  Sorted by
anchor and stretch, anchors that occur once drop out, and of equal stretches
all but the first are covered as a whole; the distinct stretches of an anchor
meet in a bucket, which builds its transform.  A passage that many documents share
makes hot anchors: a sample names them, their rows are sorted in ``SALTS`` parts by
document, and what is first in a part is put together by an aggregate.  (The sample
decides only how rows are dealt, not what is found.)  Where an anchor has too
many distinct stretches for a task, it is dealt out again by the hash of each whole
window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.common import mix64, sorted_groups, store, utf8

LENGTH = 100
GRAM = 32
#: Windows of a text that are handled at once (places take 20 bits).
CHUNK = 1 << 20
#: Share of the documents that names hot anchors, the share of its rows that makes an anchor hot (so
#: there are at most 1 / HOT of them), the least rows for that, and the parts that a hot anchor is dealt to.
SAMPLE, HOT, LEAST_HOT, SALTS = 0.02, 0.001, 20, 64
#: Bytes of distinct stretches in a bucket, about; stretches of an anchor from which it is dealt out by window.
BUCKET_BYTES = 2_000_000
MOST_STRETCHES = 20_000


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of a byte array, by doubling; ``gram`` is a power of two."""
    with np.errstate(over="ignore"):
        h = mix64(b.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        size = 1
        while size < gram:
            h = h[: len(h) - size] * np.uint64(0xD1342543DE82EF95 + 2 * size) + h[size:]
            size *= 2
        return mix64(h)


class Powers:
    """For hashes of any stretch of a text from running sums of byte codes times
    powers of an odd number, and the inverse powers (all modulo 2**64)."""

    def __init__(self):
        odd = 0x9E6C63D0676A9A99
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(CHUNK + 1, odd, np.uint64))
            self.down = np.cumprod(np.full(CHUNK + 1, pow(odd, -1, 1 << 64), np.uint64))
        self.codes = np.random.default_rng(6).integers(0, 2**64, 256, dtype=np.uint64)

    def stretches(self, b: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(self.codes[b] * self.up[: len(b)])])
            return mix64((sums[end] - sums[first]) * self.down[first] + (end - first).astype(np.uint64))


def anchors(raw: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, stretch, first, last) of a text: windows first..last (by their
    start) have this anchor; the hash of their bytes."""
    out = []
    b = np.frombuffer(raw, np.uint8)
    wide = length - gram + 1        # grams of a window
    for at in range(0, len(b) - length + 1, CHUNK - length):
        part = b[at : at + CHUNK]
        if len(part) < length:
            break
        h = gram_hashes(part, gram)
        low = np.uint64(0xFFFFF)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= wide:
            m = np.minimum(m[: len(m) - size], m[size:])
            size *= 2
        if size < wide:
            m = np.minimum(m[: len(m) - (wide - size)], m[wide - size :])
        m = m[: CHUNK - length]     # the windows that start in this chunk
        place = (m & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        last = np.append(first[1:] - 1, len(place) - 1)
        out.append((h[place[first]].view(np.int64), powers.stretches(part, first, last + length).view(np.int64), first + at, last + at))
    if not out:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


def _emit(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [anchors(x, powers, length) for x in utf8(part.column("text"))]
                n = [len(x[0]) for x in found]
                anchor, stretch, first, last = (np.concatenate(x) for x in zip(*found))
                ids = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(stretch), part.column("doc_id").take(ids), part.column("copy").take(ids), pa.array(first * SHAPE + last - first)],
                                                 ["anchor", "stretch", "doc_id", "copy", "at"])

    return run


#: A stretch's place in one number: its first window * SHAPE + its number of windows - 1.
SHAPE = 1024


def _stretches(length: int):
    """Of each text: the bytes of the stretches asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            n = asked.value_lengths().to_numpy()
            ids = np.repeat(np.arange(len(n)), n)
            fields = {k: asked.flatten().field(k) for k in ("anchor", "at", "copies")}
            at = fields["at"].to_numpy()
            first, windows = at // SHAPE, at % SHAPE + 1
            texts = utf8(batch.column("text"))
            own = [texts[i][a:b] for i, a, b in zip(ids.tolist(), first.tolist(), (first + windows - 1 + length).tolist())]
            take = pa.array(ids)
            yield pa.RecordBatch.from_arrays([fields["anchor"], batch.column("doc_id").take(take), batch.column("copy").take(take), pa.array(first), pa.array(windows.astype(np.int32)),
                                              fields["copies"], pa.array(own, pa.binary())], ["anchor", "doc_id", "copy", "first", "windows", "copies", "own"])

    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, from the first seven characters on.
    Code 0 ends a string and is in each place a character of its own, the later the greater."""
    n = len(text)
    codes = text.astype(np.int64)
    packed = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for i in range(7):
        c = np.zeros(n, np.int64)
        c[: n - i] = codes[i:]
        packed = packed * 257 + np.where(alive, c, 0)
        alive &= c != 0
    ends = np.flatnonzero(text == 0)
    # which end comes next: tells apart strings that have ended
    upto = np.searchsorted(ends, np.arange(n))
    short = ends[np.minimum(upto, len(ends) - 1)] - np.arange(n)
    order = np.argsort(packed).astype(np.int32)     # half the bytes: most of the time goes into gathers
    # strings that end within the seven, told apart by their end; no other has their characters
    at = np.flatnonzero(short[order] < 7)
    own = order[at]
    order[at] = own[np.lexsort((upto[own], packed[own]))]
    key = packed[order]
    tied = (key[1:] == key[:-1]) & ((short[order][1:] >= 7) | (upto[order][1:] == upto[order][:-1]))
    rank = np.empty(n, np.int32)
    group = np.cumsum(np.append(False, ~tied), dtype=np.int32)
    starts = np.flatnonzero(np.append(True, ~tied)).astype(np.int32)
    rank[order] = starts[group]
    size = 7
    while tied.any():
        # only members of groups move, each group within its own places
        member = np.append(tied, False) | np.append(False, tied)
        at = np.flatnonzero(member)
        own = order[at]
        behind = np.minimum(own + size, n - 1)
        key = rank[own].astype(np.int64) * n + rank[behind]
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        order[at] = own
        new = np.append(True, key[1:] != key[:-1])
        first = at[np.flatnonzero(new)].astype(np.int32)[np.cumsum(new) - 1]
        rank[own] = first
        tied = np.zeros(n - 1, bool)
        same = ~new[1:] & (at[1:] == at[:-1] + 1)
        tied[at[:-1][same]] = True
        size *= 2
    return order


def expand(text: np.ndarray, seeds: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interval expansion.  ``text``: byte codes + 1, each string ended by 0.
    ``seeds``: places just behind the windows asked for; ``weight``: how often
    each occurs.  Returns the windows (index into seeds) that occur more than
    once, and the number of each one's interval.

    An interval is held by its members among the suffixes asked for, in the
    order of the suffix array.  Backward extension takes a suffix k to LF(k); members
    of an interval with the same byte in the transform stay together, and
    intervals of total weight one are dropped.
    """
    order = suffix_order(text)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    bwt = text[order - 1]
    lf = np.empty(len(order), np.int32)
    by_char = np.argsort(bwt, kind="stable")
    lf[by_char] = np.arange(len(order), dtype=np.int32)
    # the map is wrong for steps over a string's begin, which are never taken: a window lies within its string
    rank = place[seeds]
    who = np.argsort(rank, kind="stable").astype(np.int32)
    rank = rank[who]
    interval = np.zeros(len(rank), np.int32)
    for step in range(length):
        if not len(rank):
            break
        char = bwt[rank]
        turn = np.argsort(char, kind="stable")
        rank, who, interval, char = lf[rank[turn]], who[turn], interval[turn], char[turn]
        new = np.append(True, (interval[1:] != interval[:-1]) | (char[1:] != char[:-1]))
        begins = np.flatnonzero(new)
        # intervals of one member that occurs once; they stay such, and go when they are many
        lone = begins[np.diff(np.append(begins, len(rank))) == 1]
        lone = lone[weight[who[lone]] == 1]
        interval = np.cumsum(new, dtype=np.int32) - 1
        if len(lone) > len(rank) // 8 or step == length - 1:
            live = np.ones(len(rank), bool)
            live[lone] = False
            rank, who, interval = rank[live], who[live], interval[live]
    return who, interval


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, b) of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _expand_buckets(length: int):
    """Of each bucket of distinct stretches: the windows of a stretch's first
    place that also start earlier elsewhere, as runs of bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "bucket", 1):
            raws = t.column("own").to_pylist()
            sizes = np.array([len(x) for x in raws])
            text = np.zeros(int(sizes.sum()) + len(raws), np.uint16)
            begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            inside = np.ones(len(text), bool)
            inside[begins + sizes] = False
            text[inside] = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint16) + 1
            windows = t.column("windows").to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(raws)), windows)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            who, interval = expand(text, begins[of] + nth + length, t.column("copies").to_numpy()[of], length)
            doc, copy, first = (t.column(c).to_numpy() for c in ("doc_id", "copy", "first"))
            o = of[who]
            d, c, f = doc[o], copy[o], first[o] + nth[who]
            ranked = np.lexsort((f, c, d, interval))
            d, c, f, interval = d[ranked], c[ranked], f[ranked], interval[ranked]
            head = np.flatnonzero(np.append(True, interval[1:] != interval[:-1])) if len(ranked) else ranked
            head = np.repeat(head, np.diff(np.append(head, len(ranked))))      # the earliest place of each one's interval
            later = who[ranked[(d != d[head]) | (c != c[head]) | (f != f[head])]]
            flags = np.zeros(len(of), bool)
            flags[later] = True
            starts = np.cumsum(windows) - windows
            rows: tuple[list, ...] = ([], [], [], [])
            for s in np.unique(of[later]).tolist():
                for a, b in _runs(flags[starts[s] : starts[s] + windows[s]]):
                    for out, x in zip(rows, (int(doc[s]), int(copy[s]), int(first[s]) + a, int(first[s]) + b - 1 + length)):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "copy", "a", "b"])

    return run


def _each_window(length: int):
    """Every window of a stretch by a hash of its own, for anchors with very many stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, which, nth = [], [], []
            for i, (own, n) in enumerate(zip(batch.column("own").to_pylist(), batch.column("windows").to_pylist())):
                for j in range(n):
                    keys.append(hashlib.blake2b(own[j : j + length], digest_size=16).digest())
                    which.append(i)
                    nth.append(j)
            take = pa.array(which, pa.int64())
            first = pa.array(batch.column("first").to_numpy()[which] + np.array(nth, np.int64), pa.int64()) if which else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("doc_id").take(take), batch.column("copy").take(take), first], ["key", "doc_id", "copy", "first"])

    return run


def _first_places(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, copy, at, anchor, copies) of all stretches whose anchor occurs again: the
    anchor is null where an equal stretch stands earlier; else ``copies`` is 2 if one
    stands later, and 1 if not (then the anchor has other stretches)."""
    out = "anchor long, stretch long, doc_id long, copy long, at long"
    sampled = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(10_000)) < int(SAMPLE * 10_000))
    counts = sampled.mapInArrow(_emit(length), out).groupBy("anchor").count()
    counts = store(counts.where(F.col("count") >= LEAST_HOT), "rp-often")
    total = counts.agg(F.sum("count")).first()[0] or 0
    most = int(1 / HOT)
    hot = store(counts.where(F.col("count") >= HOT * total).orderBy(F.desc("count"), "anchor").limit(most).select(F.col("anchor").alias("hot")), "rp-hot")

    found = texts.mapInArrow(_emit(length), out).join(F.broadcast(hot), F.col("anchor") == F.col("hot"), "left")
    found = found.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(-1)))
    order = Window.partitionBy("anchor", "salt").orderBy("stretch", "doc_id", "copy", "at")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.select("*", F.lag("stretch").over(order).alias("before"), F.lead("stretch").over(order).alias("behind"),
                         (F.first("stretch").over(every) != F.last("stretch").over(every)).alias("several"))
    again = F.coalesce(F.col("before") == F.col("stretch"), F.lit(False))
    copies = F.when(F.col("behind") == F.col("stretch"), 2).otherwise(1)
    cool = F.col("salt") < 0
    found = found.select("doc_id", "copy", "at", "anchor", "stretch", copies.alias("copies"), "several", again.alias("again"), cool.alias("cool"))
    found = store(found.where("again or several or not cool"), "rp-sorted")
    done = found.where("cool or again").select("doc_id", "copy", "at", F.when(~F.col("again"), F.col("anchor")).alias("anchor"), "copies")

    # a hot anchor's firsts of each part: the earliest of all is first
    parts = found.where("not cool and not again")
    own = F.struct("doc_id", "copy", "at")
    whole = store(parts.groupBy("anchor", "stretch").agg(F.min(own).alias("least"), F.sum("copies").alias("copies")), "rp-hot-stretches")
    several = store(whole.groupBy("anchor").agg((F.min("stretch") != F.max("stretch")).alias("several")), "rp-hot-anchors")
    met = parts.drop("copies", "several").join(whole, ["anchor", "stretch"]).join(several, "anchor").where("copies > 1 or several")
    met = met.select("doc_id", "copy", "at", F.when(own == F.col("least"), F.col("anchor")).alias("anchor"), F.least("copies", F.lit(2)).cast("int").alias("copies"))
    return done.union(met)


def covered(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, copy, a, b): bytes a..b-1 of a text are covered by strings of
    ``length`` bytes that also start earlier.  ``texts``: (doc_id, copy, text)."""
    place = ["doc_id", "copy", "first"]
    found = store(_first_places(texts, length), "rp-found")
    first = F.floor(F.col("at") / SHAPE)
    # all but the first place of equal stretches: covered as a whole
    whole = found.where("anchor is null").select("doc_id", "copy", first.alias("a"), (first + F.col("at") % SHAPE + length).alias("b"))

    # the first places, of anchors with several stretches
    asked = found.where("anchor is not null").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("anchor", "at", "copies")).alias("asked")).withColumnsRenamed({"doc_id": "d", "copy": "c"})
    some = texts.join(asked.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("copy") == F.col("c"))).select("doc_id", "copy", "text", "asked")
    distinct = store(some.mapInArrow(_stretches(length), "anchor long, doc_id long, copy long, first long, windows int, copies int, own binary"), "rp-distinct")
    many = store(distinct.groupBy("anchor").count().where(F.col("count") > MOST_STRETCHES).select("anchor"), "rp-many")
    size = distinct.agg(F.sum(F.length("own"))).first()[0] or 0
    buckets = max(1, int(size // BUCKET_BYTES))
    dealt = distinct.join(many, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).select("bucket", *place, "windows", "copies", "own")
    # a shuffle partition holds one or more buckets
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    out = whole.union(dealt.mapInArrow(_expand_buckets(length), "doc_id long, copy long, a long, b long"))
    single = distinct.join(many, "anchor", "left_semi").mapInArrow(_each_window(length), "key binary, doc_id long, copy long, first long")
    lowest = store(single.groupBy("key").agg(F.min(F.struct(*place)).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c"), "rp-lowest")
    late = single.join(lowest, "key").where(F.struct(*place) != F.col("f")).select("doc_id", "copy", F.col("first").alias("a"), (F.col("first") + length).alias("b"))
    return out.union(late)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for raw, runs in zip(utf8(batch.column("text")), batch.column("runs")):
            spans: list[list[int]] = []
            for x in sorted((r["a"], r["b"]) for r in runs.as_py() or []):
                if spans and x[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x[1])
                else:
                    spans.append(list(x))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            for out, x in zip(rows, (len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest())):
                out.append(x)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in rows[:3]], pa.array(rows[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each input row.

    A byte goes when a string of ``length`` bytes that covers it also starts
    earlier: in a row of smaller doc_id, or earlier in the same row.  Null
    texts count as empty; texts shorter than ``length`` keep all.  Rows with a
    null id come last.  Rows that share an id are ordered by a hash of their
    text; equal rows are one document.  Extra columns are ignored.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    # a null id sorts last; rows that share an id are told apart by a hash of the text
    rows = rows.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "text", F.col("doc_id").isNull().alias("void"))
    shared = store(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("shared")), "rp-shared")
    if shared.isEmpty():
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
        texts = rows
    else:
        rows = rows.join(shared, rows.doc_id == shared.shared, "left").withColumn("copy", F.when(F.col("shared").isNull(), 0).otherwise(F.xxhash64("text")))
        texts = rows.where("shared is null").union(rows.where("shared is not null").dropDuplicates(["doc_id", "copy"]))
    runs = covered(texts.where(F.octet_length("text") >= length).select("doc_id", "copy", "text"), length)
    per = store(runs.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "rp-runs").withColumnsRenamed({"doc_id": "d", "copy": "c"})
    joined = rows.join(per.hint("merge"), (F.col("doc_id") == F.col("d")) & (F.col("copy") == F.col("c")), "left")
    joined = joined.select(F.when(~F.col("void"), F.col("doc_id")).alias("doc_id"), "text", "runs")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
