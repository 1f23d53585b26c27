"""Ranked lexical search, term at a time with limited accumulators (operator 11).

The index is a written table of the documents' postings, dealt out by document:
a row is a document with its length and, of the queries' terms, the term numbers
and their counts.  Its statistics (documents, words, documents of a term) are
Spark aggregates over all rows.  A batch of rows is a block of the index; in it the
postings are turned into lists by term, and each query takes its terms rarest
first.  A document met in a list gets an accumulator only while the bounds of the
terms still to come (their weight times the greatest impact in the block) reach
the k-th best partial score; after that only the documents that have one are updated,
and exactly.  Nothing is lost: a document without an accumulator scores less than
k others.  A task keeps each query's k best, which also serve as a limit for
its next blocks; Spark takes the best of all tasks.

Queries go in blocks of about ``QUERY_TERMS`` terms, each searched against all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.common import store, utf8

#: Bytes of words: digits, letters (A-Z become a-z) and all of UTF-8 beyond ASCII; others part them.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: (Query, term) pairs that are searched at once: what the driver and each task hold of the queries.
QUERY_TERMS = 200_000
#: Parts that each query's best are taken in before the last choice.
PARTS = 64


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [terms(x) for x in utf8(batch.column("text"))]
        ids = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(ids), pa.array([w for x in found for w in x], pa.binary())], ["item_id", "term"])


def _index(numbers):
    """A row for each document with a word: (doc_id, n, term, tf)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.value.get
        width = max(len(numbers.value), 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, known, hits = [], [], []
                for raw in utf8(part.column("text")):
                    words = terms(raw)
                    own = [i for w in words if (i := get(w)) is not None]
                    n.append(len(words))
                    known.append(len(own))
                    hits += own
                key, tf = np.unique(np.repeat(np.arange(len(n)), known) * width + np.array(hits, np.int64), return_counts=True)
                n = np.array(n, np.int64)
                ends = np.searchsorted(key, np.arange(len(n) + 1) * width)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in ((key % width).astype(np.int32), tf.astype(np.int32))]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "term", "tf"])
                yield out.filter(pa.array(n > 0))

    return run


class _Best:
    """The k best (score, doc_id) of a query, best first; null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.void = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray, void: np.ndarray) -> None:
        score, doc, void = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.void, void)))
        turn = np.lexsort((doc, void, -score))[: self.k]
        self.score, self.doc, self.void = score[turn], doc[turn], void[turn]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that may be among the k best.

    ``lists``: each term's documents and what it adds to their scores, rarest
    term first.  ``floor``: a score that k documents are known to reach.
    Documents that stay out score less than k others do.
    """
    acc = np.zeros(size, np.int64)
    behind = np.cumsum([0, *(int(a.max()) if len(a) else 0 for _, a in reversed(lists))])[::-1]     # bounds of the terms from i on
    limited = False
    for i, (docs, add) in enumerate(lists):
        if not limited:
            kth = int(np.partition(acc, size - k)[size - k]) if size >= k else 0
            limited = int(behind[i]) < max(floor, kth)
        if limited:
            old = acc[docs] > 0
            docs, add = docs[old], add[old]
        acc[docs] += add
    some = np.flatnonzero(acc)
    if len(some) > k:
        kth = int(np.partition(acc[some], len(some) - k)[len(some) - k])
        some = some[acc[some] >= kth]
    return some, acc[some]


def _search(queries, n_docs: int, n_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = queries.value          # [(query, terms rarest first, weights with repeats)]
        best = [_Best(k) for _ in wanted]
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            ids = batch.column("doc_id")
            doc, void = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            # in Python's integers, as 25 * n * N may pass 64 bits
            m = np.array([75 + 25 * n * n_docs // n_words for n in batch.column("n").to_pylist()], np.int64)
            term = batch.column("term").flatten().to_numpy()
            of = np.repeat(np.arange(size), batch.column("term").value_lengths().to_numpy())
            tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[of])
            turn = np.argsort(term, kind="stable")
            term, of, impact = term[turn], of[turn], impact[turn]
            for b, (_, numbers, weights) in zip(best, wanted):
                lo, hi = np.searchsorted(term, numbers, "left"), np.searchsorted(term, numbers, "right")
                lists = [(of[x:y], impact[x:y] * w) for x, y, w in zip(lo.tolist(), hi.tolist(), weights) if y > x and w]
                some, score = accumulate(lists, size, k, b.least())
                b.add(score, doc[some], void[some])
        n = [len(b.score) for b in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([q for q, _, _ in wanted], n), pa.int64()),
                pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.void for b in best])),
                pa.array(np.concatenate([b.score for b in best]))], ["query", "doc_id", "score"])

    return run


def _block(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """(query, doc_id, score): the best of a block of queries, one row each."""
    spark = docs.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({bytes(t) for _, t, _ in asked}))}
    index = store(docs.mapInArrow(_index(spark.sparkContext.broadcast(numbers)), "doc_id long, n long, term array<int>, tf array<int>"), "rs-index")
    n_docs, n_words = index.agg(F.count("*"), F.sum("n")).first()
    df = dict(index.select(F.explode("term").alias("term")).groupBy("term").count().collect())      # at most a row for each term asked for
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    of: dict[int, list] = {}
    for q, t, repeats in asked:
        if numbers[bytes(t)] in df:
            of.setdefault(q, []).append((df[numbers[bytes(t)]], numbers[bytes(t)], repeats))
    queries = [(q, np.array([t for _, t, _ in sorted(x)]), [weight[t] * r for _, t, r in sorted(x)]) for q, x in sorted(of.items())]
    return index.mapInArrow(_search(spark.sparkContext.broadcast(queries), n_docs, n_words or 1, k), "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0
    for each item, best first; equal scores by doc_id.

    Null and empty texts have no terms: such documents don't count, such items
    have no result.  Rows of ``items`` that share an id are one query with the
    terms of all their different texts; a null item id is an id like others.
    Rows that repeat a document id are documents of their own, and a list may hold
    both; a null doc_id comes last among equal scores.  Extra columns are ignored.
    """
    own = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = own.schema["item_id"].dataType.simpleString()
    found = own.distinct().mapInArrow(_query_terms, f"item_id {kind}, term binary")
    found = store(found.groupBy("item_id", "term").agg(F.count("*").alias("repeats")), "rs-asked")
    ids = store(found.select("item_id").distinct().withColumn("query", F.monotonically_increasing_id()), "rs-ids")
    asked = found.join(ids.withColumnRenamed("item_id", "own"), F.col("item_id").eqNullSafe(F.col("own")))
    asked = store(asked.select("query", "term", "repeats"), "rs-terms")
    blocks = max(1, math.ceil(asked.count() / query_terms))
    part = F.pmod(F.xxhash64("query"), F.lit(blocks))
    best = None
    for b in range(blocks):
        rows = [(r["query"], r["term"], r["repeats"]) for r in asked.where(part == b).collect()]
        out = _block(texts, rows, k)
        best = out if best is None else best.unionByName(out)

    def top(df, *by):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = top(best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), "query", "part").drop("rank", "part")
    return top(best, "query").join(ids, "query").select("item_id", "rank", "doc_id", "score")


def oracle(documents: str = "documents", benchmark: str = "benchmark", k: int = 20) -> str:
    def words(text):
        return (rf"translate(unnest(regexp_extract_all(coalesce({text}, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), "
                "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

    return rf"""
WITH d AS (SELECT doc_id, {words("text")} AS term FROM {documents}),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {words("text")} AS term FROM {benchmark}) GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
m AS (SELECT doc_id, 75 + (25 * n * nn) // l AS m FROM len, total),
s AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {k}"""
