"""Exact distributed percentile, global index and prefix sums, ROC-AUC."""

import numpy as np
from pyspark.sql import functions as F

from loghawk.operators.classify import roc_auc
from loghawk.operators.stats import exact_percentile, kth_smallest
from loghawk.plans.ordered import with_global_index, with_prefix_sums


def test_kth_smallest_narrowing(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])   # a hot value
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(6)
    ks = [0, 17, 2500, 4999]
    got = kth_smallest(df, "v", ks, bins=16)
    s = np.sort(vals)
    for k in ks:
        assert got[k] == s[k]


def test_kth_smallest_infinite_and_extreme_values(spark):
    inf = float("inf")
    vals = [inf, -inf, 1e308, -1e308, 0.0, 5e-324, 1e-323, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, inf] + [float(i) for i in range(10)]
    df = spark.createDataFrame([(v,) for v in vals] + [(float("nan"),), (None,)], "v double")
    got = kth_smallest(df, "v", list(range(len(vals))), bins=4)
    assert [got[k] for k in range(len(vals))] == sorted(vals)
    assert exact_percentile(df, "v", 100) == inf
    assert exact_percentile(df.where("v is null"), "v", 50) is None


def test_exact_percentile_matches_numpy(spark):
    vals = np.random.default_rng(2).exponential(size=1001)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for q in (50, 99, 99.9):
        assert abs(exact_percentile(df, "v", q) - np.percentile(vals, q)) < 1e-12


def test_global_index_skewed(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long")
    out = with_global_index(df, ["k", "i"], "idx", num_partitions=5).toPandas()
    out = out.sort_values("idx")
    assert list(out["idx"]) == list(range(3000))
    exp = sorted(rows)
    assert list(zip(out["k"], out["i"])) == exp


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(100)], "i long, x double")
    out = with_prefix_sums(df, ["i"], {"cs": "x"}, num_partitions=4).orderBy("i").toPandas()
    assert np.allclose(out["cs"], np.cumsum([i % 4 for i in range(100)]))


def test_roc_auc_with_ties(spark):
    y = [0, 0, 1, 1, 0, 1]
    s = [0.1, 0.4, 0.35, 0.8, 0.4, 0.4]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    # pairs: pos scores .35,.8,.4 vs neg .1,.4,.4
    # .35 > .1 (1); .8 > all (3); .4 > .1, ties .4 .4 (1 + 0.5 + 0.5)
    assert abs(roc_auc(df).first()[0] - 6.0 / 9.0) < 1e-12


def test_successor_across_batches_and_partitions(spark):
    from loghawk.plans.ordered import with_successor
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("hot" if i % 5 else f"g{i % 3}", i, i * 2) for i in range(500)]
        df = spark.createDataFrame(rows, "g string, t long, id long")
        out = with_successor(df, ["g", "t"], ["id", "g"], num_partitions=13).toPandas()
        exp = sorted(rows)
        nxt = {exp[i][2]: (exp[i + 1][2], exp[i + 1][0]) for i in range(len(exp) - 1)}
        got = {r.id: (None if r.next_id is None or r.next_id != r.next_id else int(r.next_id), r.next_g)
               for r in out.itertuples()}
        assert got[exp[-1][2]][0] is None
        for k, v in nxt.items():
            assert got[k] == v
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
