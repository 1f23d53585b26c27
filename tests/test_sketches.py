"""Sketches and what stands on them; ranges in order; histograms; verdicts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghawk.operators import classify as CL
from loghawk.operators import detect as DT
from loghawk.operators import graph as GR
from loghawk.operators import profile as PR
from loghawk.operators import stats as S
from loghawk.plans.ordered import with_global_index, with_prefix_sums, with_range, with_successor
from loghawk.sources.logs import read_feedback, write_feedback


def plan_of(df):
    return df._jdf.queryExecution().toString()


# ---- percentile

@pytest.mark.parametrize("kind", ["normal", "ties", "two values", "hot middle", "infinite"])
def test_ranks_by_sketch_and_count(spark, kind):
    rng = np.random.default_rng(6)
    v = {"normal": lambda: rng.normal(size=4000), "ties": lambda: rng.integers(0, 7, 4000) / 2, "two values": lambda: rng.integers(0, 2, 4000).astype(float),
         "hot middle": lambda: np.concatenate([rng.normal(size=2500), np.zeros(1500)]),
         "infinite": lambda: np.concatenate([rng.normal(size=3000), np.full(500, np.inf), np.full(500, -np.inf)])}[kind]()
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(5)
    want = np.sort(v)
    ks = [0, 1, 39, 40, 1999, 2000, 3960, 3998, 3999]
    # a fine sketch and one pass; coarse ones, where the bounds are narrowed again
    for bins, most in ((20_000, 100_000), (200, 100), (50, 30)):
        got = S.kth_smallest(df, "v", ks, bins=bins, most=most)
        assert [got[k] for k in ks] == [want[k] for k in ks], (bins, most)
    for q in (0, 1, 50, 99, 99.9, 100):
        for accuracy, most in ((20_000, 100_000), (300, 100)):
            got = S.exact_percentile(df, "v", q, accuracy, most)
            pos = q / 100 * 3999
            a, b = want[math.floor(pos)], want[min(math.floor(pos) + 1, 3999)]
            assert got == (a if a == b else pytest.approx(a + (b - a) * (pos - math.floor(pos)), abs=1e-12)), (q, accuracy)


def test_percentile_reads_the_values_twice(spark, monkeypatch):
    """One sketch, one count between its bounds."""
    calls = []
    real = S._sketch
    monkeypatch.setattr(S, "_sketch", lambda *a: calls.append("sketch") or real(*a))
    real_ranks = S._ranks
    monkeypatch.setattr(S, "_ranks", lambda *a: calls.append("count") or real_ranks(*a))
    v = np.random.default_rng(1).normal(size=50_000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert S.exact_percentile(df, "v", 99) == pytest.approx(np.percentile(v, 99), abs=1e-12)
    assert calls == ["sketch", "count"]


def test_approximate_percentile_within_its_error(spark):
    v = np.random.default_rng(2).exponential(size=30_000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(6)
    for q in (1, 50, 99):
        got = S.approx_percentile(df, "v", q, 500)
        rank = (v < got).mean()
        assert abs(rank - q / 100) <= 1 / 500 + 1e-3
    assert S.approx_percentile(df.limit(0), "v", 50) is None


# ---- distinct counts

def test_sketches_unite_over_days(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("day"), F.col("id").alias("a"), (F.col("id") % 700).cast("double").alias("b"),
                                    F.when(F.col("id") % 4 > 0, F.concat(F.lit("x"), F.col("id") % 50)).alias("c"))
    stored = PR.column_sketches(df, ["day"], rsd=0.01)
    assert stored.count() == 3 * 4
    got = {r.column: r for r in PR.profile_from_sketches(df, stored).collect()}
    exact = {r.column: r for r in PR.profile_columns(df).collect()}
    assert [r for r in got] == df.columns == [r for r in exact]
    assert {c: r.distinct_values for c, r in exact.items()} == {"day": 3, "a": 60_000, "b": 700, "c": 50}
    for c in df.columns:
        assert abs(got[c].distinct_values - exact[c].distinct_values) <= 0.03 * exact[c].distinct_values
        assert (got[c].nulls, got[c].null_pct, got[c].data_type) == (exact[c].nulls, exact[c].null_pct, exact[c].data_type)
    assert exact["c"].nulls == 15_000
    one = {r.column: r.distinct_values for r in PR.profile_columns(df, approx=True).collect()}
    assert one == {c: r.distinct_values for c, r in got.items()}


def test_exact_profile_of_odd_values(spark):
    df = spark.createDataFrame([(0.0, [1], None, b"\xff"), (-0.0, [1], None, b"\xfe"), (float("nan"), [2], None, None), (float("nan"), None, None, None)],
                               "d double, a array<int>, n string, b binary")
    got = {r.column: (r.distinct_values, r.nulls) for r in PR.profile_columns(df).collect()}
    assert got == {"d": (2, 0), "a": (2, 1), "n": (0, 4), "b": (2, 2)}
    assert "Expand" not in plan_of(PR.profile_columns(df))
    empty = PR.profile_columns(df.limit(0)).collect()
    assert [(r.column, r.distinct_values, r.nulls, r.null_pct) for r in empty] == [(c, 0, 0, None) for c in df.columns]


# ---- histogram

def test_histogram_with_infinite_values(spark):
    inf = float("inf")

    def rows(values, bins):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return sorted(tuple(r) for r in PR.histogram(df, "v", bins).collect())

    assert rows([1.0, 2.0, inf], 1) == [(0, 1.0, 2.0, 2), (1, 2.0, inf, 1)]
    assert rows([1.0, 2.0, inf, -inf, -inf, float("nan"), None], 2) == [(-1, -inf, 1.0, 2), (0, 1.0, 1.5, 1), (1, 1.5, 2.0, 1), (2, 2.0, inf, 1)]
    assert rows([inf, inf], 3) == [(3, None, inf, 2)]
    assert [r[3] for r in rows([-1.5e308, 0.0, 1.5e308, 1.5e308], 2)] == [1, 3]
    assert rows([], 4) == []


# ---- order without Python or a single partition

def test_ranges_are_balanced_and_ordered(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 9}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i long")
    got = with_range(df, ["k", "i"], 16).collect()
    key = lambda r: (r.k is not None, r.k or "", r.i)
    order = [r["__range"] for r in sorted(got, key=key)]
    assert order == sorted(order) and set(order) == set(range(16))
    assert max(order.count(x) for x in set(order)) < 4 * 5000 / 16
    assert {r["__range"] for r in with_range(df, ["k", "i"], 1).collect()} == {0}
    assert with_range(df.limit(0), ["k", "i"], 4).collect() == []


def test_order_has_no_python_worker(spark):
    df = spark.createDataFrame([(f"10.0.0.{i % 7}", f"/e{i % 3}", i, float(i % 5)) for i in range(200)], "ip_address string, endpoint string, log_id long, score double")
    label = df.select((F.col("log_id") % 2).cast("int").alias("label"), "score")
    for out in (with_prefix_sums(df, ["log_id"], {"s": "score"}), with_global_index(df, ["log_id"]), with_successor(df, ["log_id"], ["log_id"]),
                GR.sequential_edges(df, ["log_id"], ["ip_address"]), GR.bipartite_nodes(df), CL.roc_auc(label)):
        assert "Python" not in plan_of(out) and "MapIn" not in plan_of(out)
    assert with_global_index(df.limit(0), ["log_id"]).collect() == []


def test_confusion_has_no_cartesian_product(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 0), (None, 1)], "label int, prediction int")
    out = CL.confusion(df)
    assert "Cartesian" not in plan_of(out) and "NestedLoop" not in plan_of(out)
    got = {(r.label, r.prediction): r["count"] for r in out.collect()}
    assert got == {(a, b): {(0, 0): 1, (0, 1): 1, (2, 0): 1}.get((a, b), 0) for a in (0, 1, 2) for b in (0, 1, 2)}
    assert CL.confusion(df.limit(0)).collect() == []


# ---- verdicts

def test_feedback_retries_change_nothing(spark, tmp_path):
    path = str(tmp_path / "feedback")
    verdicts = lambda rows: spark.createDataFrame(rows, "log_id long, is_true_anomaly boolean")
    for batch, rows in ((0, [(1, True), (2, False), (None, True)]), (1, [(2, True), (3, False), (3, True)]), (0, [(1, True), (2, False), (None, True)])):
        write_feedback(verdicts(rows), path, batch_id=batch)
    got = {r.log_id: r.is_true_anomaly for r in read_feedback(spark, path).collect()}
    assert got == {1: True, 2: True, 3: True}
    m = DT.feedback_metrics(read_feedback(spark, path)).first()
    assert (m.true_positives, m.false_positives) == (3, 0)


def test_suppressed_flags(spark):
    scored = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True), (4, None, True)], "log_id long, ip string, is_anomaly boolean")
    fb = spark.createDataFrame([("a", False), ("b", False), ("b", True)], "ip string, is_true_anomaly boolean")
    got = {r.log_id: (r.is_anomaly, r.suppressed) for r in DT.suppress(scored, fb, ["ip"]).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False)}
