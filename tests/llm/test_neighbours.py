"""The forest against brute force."""

import numpy as np

from loghawk.llm.neighbours import nearest


def brute(ids, x, every=100, k=10):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            out[i] = [(j, e) for e, j in sorted((e, j) for e, j in zip(d, ids) if j != i)[:k]]
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    want = brute([r[0] for r in rows], np.array([r[1] for r in rows], np.float64))
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = 0
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 11))
        assert [ranks[i][1] for i in range(1, 11)] == sorted(ranks[i][1] for i in range(1, 11))
        exact = dict(want[q])
        hits += sum(j in exact for j, _ in ranks.values())
        assert all(abs(exact[j] - e) < 1e-12 for j, e in ranks.values() if j in exact)
    assert hits / (10 * len(want)) >= 0.9


def test_recall_at_the_share_in_use(spark):
    """20,000 vectors without clusters, where search_share alone decides: about half of the distinct vectors are read."""
    from loghawk.llm.neighbours import Tree, walk
    x = np.random.default_rng(7).standard_normal((20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    want = brute(range(len(x)), x.astype(np.float64))
    found = {}
    for r in nearest(df, search_rows=0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = sum(len(found[q] & {j for j, _ in w}) for q, w in want.items()) / (10 * len(want))
    # the same walk over the same trees: which vectors it reads
    trees = [Tree(x, 256, 2000 + i) for i in range(24)]
    leaves = [t.route(x) for t in trees]
    sizes = [np.bincount(n, minlength=t.leaves) for n, t in zip(leaves, trees)]
    shares = []
    for q in want:
        read = np.zeros(len(x), bool)
        for i, leaf in walk(trees, sizes, x[q], int(0.8 * len(x))):
            read |= leaves[i] == leaf
        shares.append(read.mean())
    print("recall", recall, "distinct share read", np.mean(shares))
    assert recall >= 0.9 and 0.3 < np.mean(shares) < 0.6


def test_equal_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(150)] + [(1000 + i, [1.0] * 8) for i in range(301)]
    odd = [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [float("inf")] + [1.0] * 7), (2400, [None] + [1.0] * 7), (None, [1.0] * 8), (2500, []), (2600, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, score double")
    x = np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    want = brute([i for i, _ in rows], x)
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q in (1000, 1100, 1200, 1300):
        assert [j for _, j, _ in sorted(got[q])] == [j for j, _ in want[q]]
    few = df.where("vec_id < 1 or vec_id in (1, 2)")
    assert sorted((r.rank, r.vec_id) for r in nearest(few).collect() if r.query_id == 0)[0][0] == 1 and nearest(few).count() == 2
    assert nearest(df.limit(0)).collect() == [] and nearest(df.where("vec_id = 2000")).collect() == []
