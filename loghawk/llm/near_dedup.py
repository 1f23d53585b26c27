"""MinHash near-duplicate detection (operator 5).

Plan: one pass over the texts keeps 180 universal-hash minima a document (one
byte of each) and a digest of its shingle set.  Equal sets collapse to one
representative.  Bands of minima are bucket keys; inside a bucket the minima of
each pair are compared, and where they promise enough similarity the pair is
verified on the full shingle sets.  A bucket above a block is dealt out in two
rounds, so that no task gets an unbounded group and no pair is left out.  First
each block is compared within, together with a few pivots that all blocks of
the bucket share.  The components of what that verifies settle most members;
then only pairs of different components are compared, those of the bucket's
other components with each other and with its largest, as pairs of blocks.
What leaves a task are at most (rows - 1) verified links, a forest that
connects what the pairs connect.  Components follow by large-star/small-star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghawk.llm.common import mix64, sorted_groups, store, utf8
from loghawk.llm.components import connected_components

HASHES = 180
#: Rows of a block; a task compares two blocks.
BLOCK_ROWS = 512
#: Shingles of a block, so that long documents make smaller blocks.
BLOCK_SHINGLES = 1_000_000
#: Standard deviations that the share of equal minima may lie under the threshold: far enough that the bands decide what is lost.
MARGIN = 6.0
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

SIGNED = "doc_id long, n_shingles long, digest binary, sig binary"


class _Words(dict):
    """Word -> 64-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = x = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return x


def shingles(text: bytes, k: int, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text (A-Z
    lower-cased); a text of fewer words is one shingle; none without words."""
    parts = text.translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    with np.errstate(over="ignore"):
        n = min(k, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """One byte of each universal-hash minimum."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            np.minimum(least, (x[i : i + 1024, None] * a + b).min(axis=0), out=least)
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def hash_family(n: int = HASHES, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), rng.integers(0, 2**32, n, dtype=np.uint32)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = _Words(), hash_family()
        for batch in batches:
            ids, n, digests, sigs = batch.column(0), [], [], []
            for text in utf8(batch.column(1)):
                s = shingles(text, k, words)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, a, b) if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return run


def gate(percent: int) -> float:
    """Equal minima from which a pair goes on to the exact check."""
    return max(0.0, percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / HASHES) ** 0.5) * HASHES


def _candidates(percent: int, rows: int):
    """Of each block pair: the members of pairs whose minima promise the
    similarity.  A pair counts only in the first band that it shares."""
    least = gate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "task", 4096):
            task, n, block, band, split, root = (t.column(c).to_numpy() for c in ("task", "n_shingles", "block", "band", "split", "root"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            ends = np.append(np.flatnonzero(task[1:] != task[:-1]) + 1, len(task))
            counts = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(task)) - 1
            wanted = np.zeros(len(task), bool)
            total = np.cumsum(counts)
            at = 0
            while at < len(task):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 100_000, "right")))
                c = counts[at:upto]
                i = np.repeat(np.arange(at, upto), c)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                at = upto
                ok = ((block[i] != block[j]) | ~split[i]) & (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                i, j = i[ok], j[ok]
                same = sig[i] == sig[j]
                ok = same.sum(axis=1) >= least
                i, j, same = i[ok], j[ok], same[ok]
                ok = same.reshape(len(i), HASHES // rows, rows).all(axis=2).argmax(axis=1) == band[i] if len(i) else np.zeros(0, bool)
                wanted[i[ok]] = wanted[j[ok]] = True
            out = t.filter(pa.array(wanted)).select(["task", "id", "sig", "n_shingles", "root"]).combine_chunks()
            yield from out.to_batches()

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingles(x, k, words).tobytes() for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _verify(percent: int):
    """Exact check of the pairs of each task on the full sets, likeliest
    first; pairs that are already connected need no check."""
    least = gate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, "task", 1):
            ids = t.column("id").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            raw = t.column("shingles").to_pylist()
            sets: list = [None] * len(ids)
            # what is connected already is one from the start
            seen: dict[int, int] = {}
            root = [seen.setdefault(x, i) for i, x in enumerate(t.column("root").to_pylist())]

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            pairs = []
            for i in range(len(ids) - 1):
                equal = (sig[i + 1 :] == sig[i]).sum(axis=1)
                hits = np.flatnonzero(equal >= least)
                pairs.append(np.stack([equal[hits], np.full(len(hits), i), hits + i + 1]))
            p = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), int)
            p = p[:, np.argsort(-p[0], kind="stable")]
            u, v = [], []
            for i, j in zip(p[1].tolist(), p[2].tolist()):
                a, b = find(i), find(j)
                if a == b:
                    continue
                for x in (i, j):
                    if sets[x] is None:
                        sets[x] = frozenset(np.frombuffer(raw[x], np.uint64).tolist())
                shared = len(sets[i] & sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    root[a] = b
                    u.append(ids[i])
                    v.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _blocks(m: str, weight: str) -> Column:
    return F.greatest(F.ceil(F.col(m) / BLOCK_ROWS), F.ceil(F.col(weight) / BLOCK_SHINGLES)).cast("int")


def _pivots() -> list[Column]:
    """Of a bucket: the member of smallest id, and those of smallest and greatest hash, which other buckets of its members mostly share."""
    return [F.min("id").alias("p0"), F.min_by("id", F.xxhash64("id")).alias("p1"), F.max_by("id", F.xxhash64("id")).alias("p2")]


def _open(member: DataFrame, comps: DataFrame) -> DataFrame:
    """Tasks of the pairs of large buckets that aren't connected yet.  Members of a
    bucket's largest component are settled among themselves; the others are
    open, to be compared with each other (blocks 0 .. o - 1) and with the
    settled (blocks from o)."""
    rooted = member.join(comps, member.id == comps.node, "left").select("id", "n_shingles", "band", "bucket", F.coalesce("component", "id").alias("root"))
    rooted = store(rooted, "nd-rooted")
    key = ["band", "bucket"]
    parts = rooted.groupBy(*key, "root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("weight"))
    home = parts.groupBy(*key).agg(F.max(F.struct("m", "root", "weight")).alias("home"), F.sum("m").alias("m"), F.sum("weight").alias("weight"))
    home = home.where("m > home.m").select(*key, F.col("home.root").alias("home"), (F.col("m") - F.col("home.m")).alias("om"), (F.col("weight") - F.col("home.weight")).alias("ow"), F.col("home.m").alias("sm"), F.col("home.weight").alias("sw"))
    home = store(home.select(*key, "home", _blocks("om", "ow").alias("o"), _blocks("sm", "sw").alias("s")), "nd-home")
    some = rooted.join(home, key).withColumn("block", F.expr("cast(if(root = home, o + pmod(xxhash64(id, band), s), pmod(xxhash64(id, band), o)) as int)"))
    return some.select("id", "band", "root", "block", F.explode(F.expr(
        "transform(sequence(0, if(root = home, o, o + s) - 1), x -> struct(xxhash64(bucket, band, least(x, block), greatest(x, block)) as task, x <> block as split))")).alias("p")).select("id", "band", "root", "block", "p.task", "p.split")


def _links(dealt: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, rows: int, name: str) -> DataFrame:
    """(u, v): a forest of the verified pairs of each task.  ``dealt``: (id, band,
    root, block, task, split); pairs of one root are connected already."""
    full = dealt.join(reps, "id").repartition("task").sortWithinPartitions("task", "id")
    asked = store(full.mapInArrow(_candidates(percent, rows), "task long, id long, sig binary, n_shingles long, root long"), f"{name}-asked")
    needed = asked.select("id").distinct()
    # merged at every size: a plan that broadcasts the ids while they are few tells nothing about a larger run
    sets = texts.join(needed.hint("merge"), texts.doc_id == needed.id, "left_semi").mapInArrow(_sets(k), "id long, shingles binary")
    sets = store(sets, f"{name}-sets")
    proof = asked.join(sets, "id").select("task", "id", "sig", "shingles", "root").repartition("task").sortWithinPartitions("task", "id")
    return store(proof.mapInArrow(_verify(percent), "u long, v long"), f"{name}-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each input row.

    Documents are linked when 100 * shared >= percent * united of their
    distinct k-word shingles.  ``rows`` minima make a band.  With 180 minima
    and the defaults a pair at the threshold shares no band with a probability
    of 5.7e-7 and doesn't reach the gate on equal minima with 1e-8 (percent=85,
    rows=6: 6.3e-7 and 3.4e-8): together one pair in 1.5 million is lost at
    most, for independent minima.

    Null and empty texts and texts of blanks have no shingle and link with
    nothing.  Rows with a null id are returned with a null component and
    kept.  Rows that repeat an id are one node.  Extra columns are ignored.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = store(texts.mapInArrow(_sign(k), SIGNED), "nd-signed")
    useful = signed.where("digest is not null and doc_id is not null")
    classes = store(useful.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size")), "nd-classes")
    reps = store(useful.join(classes, "digest").where("doc_id = rep").groupBy("digest", F.col("rep").alias("id"), "n_shingles").agg(F.min("sig").alias("sig")).drop("digest"), "nd-reps")

    bands = HASHES // rows
    member = reps.select("id", "n_shingles", F.explode(F.expr(
        f"transform(sequence(0, {bands - 1}), b -> struct(b as band, xxhash64(b, substring(sig, b * {rows} + 1, {rows})) as bucket))")).alias("k")).select("id", "n_shingles", "k.band", "k.bucket")
    buckets = member.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("weight"), *_pivots()).where("m > 1")
    buckets = store(buckets.select("band", "bucket", _blocks("m", "weight").alias("blocks"), F.array("p0", "p1", "p2").alias("pivots")), "nd-buckets")
    placed = member.join(buckets, ["band", "bucket"]).withColumn("block", F.expr("cast(pmod(xxhash64(id, band), blocks) as int)"))
    # each block within, with the bucket's pivots
    within = placed.select("id", "band", F.col("id").alias("root"), "bucket", F.explode(F.expr("if(array_contains(pivots, id), sequence(0, blocks - 1), array(block))")).alias("block"))
    within = within.select("id", "band", "root", "block", F.expr("xxhash64(bucket, band, block)").alias("task"), F.lit(False).alias("split"))
    links = _links(within, reps, texts, k, percent, rows, "nd-within")
    large = buckets.where("blocks > 1").select("band", "bucket")
    if not large.isEmpty():
        comps = store(connected_components(links), "nd-settled")
        links = comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(
            _links(_open(member.join(large, ["band", "bucket"]), comps), reps, texts, k, percent, rows, "nd-open"))
    comps = connected_components(links)

    by_class = classes.join(comps, classes.rep == comps.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    found = signed.where("digest is not null").join(by_class, "digest", "left").select("doc_id", "n_shingles", "component_id")
    # apart, so that the empty texts don't meet in one task
    found = found.union(signed.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    one = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), one).alias("component_id"),
                        F.coalesce(F.col("doc_id") == one, F.lit(True)).alias("kept"))


def first_of_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, rows: int = 5) -> DataFrame:
    """``docs`` without the rows that are near copies of a row with a smaller
    id.  Rows that share an id stay or go together."""
    gone = store(near_duplicates(docs, id_col, text_col, k, percent, rows).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "nd-gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return whole.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
