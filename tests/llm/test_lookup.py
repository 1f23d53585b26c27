"""Ranked search, periodic runs and benchmark decontamination against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute import LOWER, WORD
from fixtures import documents, empty, odd  # noqa: F401

from loghawk.llm import ranked_search
from loghawk.llm.decontaminate import contaminated, phrase_matches, proximity_matches, token_index
from loghawk.llm.periodic_runs import WaveletTree, periodic_runs, repeated_tail, runs_of
from loghawk.llm.ranked_search import accumulate, search

SF = "/root/testdata/sf0.001"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, term string, pos int, phrase string"


def pairs(df, key="doc_id"):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


@pytest.fixture(scope="session")
def items(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd_items(spark):
    """Null and repeated ids, null, empty, short and very long texts, clashing columns."""
    rows = [(1, "Seven wise men look on and say nothing at all about the matter"), (2, "first line"), (3, None), (4, ""), (5, " .. "),
            (None, "alpha BETA gamma"), (2, "delta epsilon"), (2, "delta epsilon"), (6, "x"), (7, "é" * 40), (8, "nowhere found words"),
            (9, " ".join(f"word{i % 997}x{i % 13}" for i in range(3000)))]
    return spark.createDataFrame([(i, t, 1, "clash", 2, "clash") for i, t in rows], ITEMS)


# ---- ranked search

def brute_search(docs, items, k=20):
    def words(t):
        return ALNUM.findall((t or "").translate(LOWER))

    own = [(i, collections.Counter(words(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_words = len(own), sum(n for _, _, n in own)
    df = collections.Counter(w for _, c, _ in own for w in c)
    queries = collections.defaultdict(collections.Counter)
    for i, t in {(i, t) for i, t in items}:
        queries[i].update(words(t))
    out = []
    for q, asked in queries.items():
        found = []
        for i, c, n in own:
            m = 75 + 25 * n * n_docs // n_words
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, r in asked.items() if w in c)
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_matches_brute_force(documents, items):
    want = brute_search(pairs(documents), pairs(items, "item_id"))
    assert rows_of(search(documents, items)) == want
    # several blocks of queries, several blocks of documents, fewer results
    want = brute_search(pairs(documents), pairs(items, "item_id"), 3)
    spark = documents.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert rows_of(search(documents, items, k=3, query_terms=300)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_search_odd_rows(odd, empty, odd_items, spark):
    assert rows_of(search(odd, odd_items)) == brute_search(pairs(odd), pairs(odd_items, "item_id"))
    assert rows_of(search(empty, odd_items)) == []
    assert rows_of(search(odd, odd_items.limit(0))) == []
    ties = spark.createDataFrame([(i, "same words here") for i in range(30, 0, -1)] + [(99, "other")], "doc_id long, text string")
    got = rows_of(search(ties, spark.createDataFrame([(1, "same")], "item_id long, text string")))
    assert sorted(r[2] for r in got) == list(range(1, 21)) and all(r[1] == r[2] for r in got)


def test_limited_accumulators_lose_nothing():
    """Accumulators stop early, yet the k best of the block are those of all documents."""
    rng = np.random.default_rng(5)
    stopped = 0
    for _ in range(200):
        size, k = int(rng.integers(5, 200)), int(rng.integers(1, 6))
        full = np.zeros(size, np.int64)
        lists = []
        for share, most in ((0.1, 1000), (0.2, 300), (0.6, 40), (0.9, 4)):
            docs = np.flatnonzero(rng.random(size) < share)
            lists.append((docs, rng.integers(1, most, len(docs))))
            full[docs] += lists[-1][1]
        some, score = accumulate(lists, size, k)
        assert (full[some] == score).all()
        kth = np.sort(full)[::-1][min(k, size) - 1]
        assert set(np.flatnonzero(full >= max(kth, 1))) <= set(some.tolist())
        met = set()
        for docs, _ in lists:
            met |= set(docs.tolist())
        stopped += len(some) < len(met)
        floor = int(np.sort(full)[::-1][0])
        some, score = accumulate(lists, size, k, floor)
        assert (full[some] == score).all() and int(np.argmax(full)) in some
    assert stopped


def test_query_blocks_are_bounded(monkeypatch, documents, items):
    """Each search holds about as many query terms as allowed."""
    sizes = []
    monkeypatch.setattr(ranked_search, "_block", lambda docs, asked, k, keep=ranked_search._block: sizes.append(len(asked)) or keep(docs, asked, k))
    search(documents, items, query_terms=400)
    assert len(sizes) > 2 and max(sizes) < 900


# ---- periodic runs

def brute_runs(x):
    found = {}
    for q in range(1, len(x) // 3 + 1):
        j = 0
        while j < len(x) - q:
            s = j
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j + q - s >= max(24, 3 * q):
                found.setdefault((s, j + q), q)
            j += 1
    return sorted((s, q, e) for (s, e), q in found.items())


def brute_periodic(rows, replace=True):
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        n = len(w)
        if replace and d is not None and n and zlib.crc32(str(d).encode()) % 10 == 0:
            g = zlib.crc32(str(d).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(((-Fraction(e - s, q), s, q, e) for s, q, e in runs), default=None)
        best = (None,) * 4 if best is None else (best[1], best[3] - best[1], best[2], 1000 * (best[3] - best[1]) // best[2])
        gone = {i for s, q, e in runs for i in range(s + q, e)}
        told = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(rng, n):
    x = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(n)]
    if rng.random() < 0.4 and n:       # words of words, cut and disturbed
        unit = [rng.randrange(2) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 8) + [rng.randrange(3) for _ in range(rng.randrange(4))]
        x = (unit * (n // len(unit) + 2))[rng.randrange(len(unit)):][:n]
    for _ in range(rng.randrange(4) if n else 0):
        a, p, long = rng.randrange(n), rng.randrange(1, max(2, n // 3)), rng.randrange(n)
        for i in range(a + p, min(n, a + long)):
            x[i] = x[i - p]
    for _ in range(rng.randrange(3) if n else 0):
        x[rng.randrange(n)] = 99
    return x


def test_runs_match_brute_force():
    rng = random.Random(12)
    total = 0
    for turn in range(1500):
        x = planted(rng, rng.choice([0, 5, 23, 24, 30, 60, 120, 200, 400] + [1500] * (turn % 50 == 0)))
        start, end, period = runs_of(np.array([*x, 1000], np.int64), len(x))
        want = brute_runs(x)
        assert list(zip(start.tolist(), period.tolist(), end.tolist())) == want, x
        total += len(want)
    assert total > 300


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    values = rng.permutation(300)
    tree = WaveletTree(values)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(lo + rng.integers(1, 60, 500), 300)
    than = rng.integers(0, 300, 500)
    assert tree.smaller(lo, hi, than).tolist() == [int((values[a:b] < t).sum()) for a, b, t in zip(lo, hi, than)]
    nth = rng.integers(0, 60, 500) % (hi - lo)
    assert tree.select(lo, hi, nth).tolist() == [int(np.sort(values[a:b])[c]) for a, b, c in zip(lo, hi, nth)]


def test_periodic_runs_match_brute_force(documents, spark):
    rows = [(i, t) for i, t in pairs(documents) if len(t or "") < 8000]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in periodic_runs(some, tail=repeated_tail).collect()), key=str) == brute_periodic(rows)
    assert periodic_runs(documents, tail=repeated_tail).count() == documents.count()
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{v}" for v in planted(rng, rng.choice([0, 30, 80, 300])))) for i in range(200)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_periodic(rows, False)
    for chunk_words in (1, 700, 1 << 19):       # documents alone, few and all of a partition at once
        assert sorted((tuple(r) for r in periodic_runs(made, chunk_words=chunk_words).collect()), key=str) == want


def test_periodic_runs_odd_rows(odd, empty):
    rows = [(i, t) for i, t in pairs(odd) if len(t or "") < 10_000]
    got = periodic_runs(odd, tail=repeated_tail)
    long = {6, 7}
    assert sorted((tuple(r) for r in got.collect() if r.doc_id not in long), key=str) == brute_periodic(rows)
    assert got.where("doc_id in (6, 7)").count() == 2
    assert periodic_runs(empty).collect() == []
    # the very long text is a period of 997 * 13 words, once and a bit: no run
    assert [r.n_runs for r in periodic_runs(odd).where("doc_id = 6").collect()] == [0]


# ---- decontamination

def brute_contaminated(docs, items, width=10):
    def words(t):
        return ALNUM.findall((t or "").translate(LOWER))

    of = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(len(w) - width + 1, 1) if w else 0):
            of[tuple(w[a:a + width])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, names = set(), set()
        for n in {len(p) for p in of}:
            for a in range(len(w) - n + 1):
                if (p := tuple(w[a:a + n])) in of:
                    hit |= set(range(a, a + n))
                    names |= of[p]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contaminated_matches_brute_force(documents, items):
    got = sorted((tuple(r) for r in contaminated(documents, items).collect()), key=str)
    assert got == brute_contaminated(pairs(documents), pairs(items, "item_id"))
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_contaminated_odd_rows(odd, empty, odd_items):
    got = sorted((tuple(r) for r in contaminated(odd, odd_items).collect()), key=str)
    assert got == brute_contaminated(pairs(odd), pairs(odd_items, "item_id"))
    assert contaminated(empty, odd_items).collect() == []
    assert not any(r.contaminated for r in contaminated(odd, odd_items.limit(0)).collect())


def test_contaminated_with_few_words(spark):
    """Frequent words, repeated words within a phrase, overlaps, hits of several windows."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for i in range(15)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in contaminated(d, b, width=5).collect()), key=str) == brute_contaminated(docs, items, 5)


def test_phrases_and_proximity(spark):
    docs = [(1, "the cat sat on the mat and the dog"), (2, "dog the cat"), (3, "mat the on sat cat the"), (4, "cat x x x x mat"), (5, "sat " * 30 + "cat mat")]
    index = token_index(spark.createDataFrame(docs, "doc_id long, text string"))
    phrases = spark.createDataFrame([(1, ["the", "cat"]), (2, ["the", "mat"]), (3, ["cat", "sat", "mat"]), (4, ["cat"]), (5, ["cow", "cat"])], "phrase_id long, phrase array<string>")
    got = sorted((r.phrase_id, r.doc, r.start) for r in phrase_matches(index, phrases).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (2, 1, 4), (4, 1, 1), (4, 2, 2), (4, 3, 4), (4, 4, 0), (4, 5, 30)]
    for span in (2, 3, 4, 5, 6, 7):
        near = {(r.phrase_id, r.doc) for r in proximity_matches(index, phrases, span).collect()}
        want = set()
        for p, words in ((1, ["the", "cat"]), (2, ["the", "mat"]), (3, ["cat", "sat", "mat"]), (4, ["cat"]), (5, ["cow", "cat"])):
            for d, t in docs:
                w = t.split()
                if any(set(words) <= set(w[a:a + span]) for a in range(len(w))):
                    want.add((p, d))
        assert near == want, span


def test_contaminated_is_native(odd, odd_items):
    plan = contaminated(odd, odd_items)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapInPandas", plan)
    assert plan.count("CartesianProduct") == plan.count("BroadcastNestedLoopJoin") == 0
