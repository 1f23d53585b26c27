"""Attention in one aggregate, convolution, and classification of many graphs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghawk.operators import graph as GR
from loghawk.operators import graph_model as GM


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_softmax_sums_with_far_scores(spark):
    """Scores hundreds apart, of both signs, with weights: the plain formula in logs."""
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for key in range(12):
        n = int(rng.integers(1, 40))
        e = rng.normal(scale=[1, 30, 400, 2000][key % 4], size=(n, 2))
        v, w = rng.normal(size=(n, 6)), rng.integers(1, 5, n).astype(float)
        rows += [(key, float(w[i]), v[i].tolist(), e[i].tolist()) for i in range(n)]
        x = w[:, None] * np.exp(e - e.max(axis=0))
        want[key] = np.concatenate([(x[:, h, None] * v[:, 3 * h:3 * h + 3]).sum(axis=0) / x[:, h].sum() for h in range(2)])
    df = spark.createDataFrame(rows, "key int, weight double, proj array<double>, e array<double>").repartition(5)
    got = {r.key: np.array(r.out) for r in GR.softmax_sums(df, "key", 2, 3).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert np.allclose(got[key], want[key], rtol=1e-9, atol=1e-12), key


def test_vectors_move_once(spark):
    """The projected vectors are joined to the edges and go straight into a partial aggregate."""
    nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "node_id long, features array<double>")
    edges = spark.createDataFrame([(i, (i * 7) % 30) for i in range(30)], "src long, dst long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = GR.attend(nodes, edges, GR.init_attention(2, 3, 2))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Join ") == 2


def dense_convolution(x, edges, w, b):
    n = len(x)
    a = np.eye(n)
    for s, d in edges:
        if s != d:
            a[d, s] += 1
    deg = np.sqrt(a.sum(axis=1))
    v = (a / deg[:, None] / deg[None, :]) @ x @ w + b
    return np.where(v > 0, v, np.expm1(v))


def test_convolution_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x, w, b = rng.normal(size=(9, 3)), rng.normal(size=(3, 4)), rng.normal(size=4)
    pairs = [(int(s), int(d)) for s, d in rng.integers(0, 8, (30, 2))]       # repeats, self loops; node 8 has none
    nodes = spark.createDataFrame([(i, x[i].tolist()) for i in range(9)], "node_id long, features array<double>")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.node_id: r.features for r in GR.convolve(nodes, edges, w, b).collect()}
    assert np.allclose([got[i] for i in range(9)], dense_convolution(x, pairs, w, b))
    assert GR.convolve(nodes.limit(0), edges.limit(0), w, b).collect() == []


@pytest.fixture(scope="module")
def log(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"10.0.0.{i % 3}" if i % 11 else None, start + dt.timedelta(hours=5 * (i * 13 % 40)), float(i % 7), 500 if i % 9 == 0 else 200) for i in range(90)]
    return spark.createDataFrame(rows, "log_id long, ip_address string, request_time timestamp_ntz, x double, status_code int").withColumn("day", F.to_date("request_time"))


def test_a_batch_of_graphs(spark, log):
    nodes, edges, graphs = GM.graph_batch(log, ["x"], ["ip_address", "day"], (F.col("status_code") >= 500).cast("int"))
    rows = [r for r in log.collect() if r.ip_address]
    keys = sorted({(r.ip_address, r.day) for r in rows})
    label = {k: max(int(r.status_code >= 500) for r in rows if (r.ip_address, r.day) == k) for k in keys}
    assert [(r.graph_id, r.label) for r in graphs.orderBy("graph_id").collect()] == [(i, label[k]) for i, k in enumerate(keys)]
    assert {(r.node_id, r.graph_id) for r in nodes.collect()} == {(r.log_id, keys.index((r.ip_address, r.day))) for r in rows}
    want = set()
    for k in keys:
        ids = [r.log_id for r in sorted(rows, key=lambda r: (r.request_time, r.log_id)) if (r.ip_address, r.day) == k]
        want |= set(zip(ids, ids[1:])) | set(zip(ids[1:], ids))
    assert {(r.src, r.dst) for r in edges.collect()} == want


def test_a_batch_gives_what_each_graph_gives_alone(spark, log):
    nodes, edges, graphs = GM.graph_batch(log, ["x"], ["ip_address", "day"], F.lit(0))
    layers = [GR.init_attention(1, 3, 2, seed=1), GR.init_attention(6, 2, 1, seed=2)]
    both = {r.graph_id: r.pooled for r in GM.pooled_graphs(nodes, edges, layers, "add").collect()}
    assert len(both) == graphs.count()
    for g in (0, 5):
        own = nodes.where(F.col("graph_id") == g)
        ids = [r.node_id for r in own.collect()]
        alone = GM.pooled_graphs(own, edges.where(F.col("src").isin(ids)), layers, "add").collect()
        assert len(alone) == 1 and np.allclose(alone[0].pooled, both[g])


def test_graph_classifier_learns(spark, log):
    busy = log.withColumn("x", F.when(F.col("ip_address") == "10.0.0.1", F.col("x") + 9).otherwise(F.col("x")))
    nodes, edges, graphs = GM.graph_batch(busy, ["x"], ["ip_address", "day"], (F.col("ip_address") == "10.0.0.1").cast("int"))
    model = GM.fit_graph_classifier(nodes, edges, graphs, [GR.init_attention(1, 4, 2, seed=3)], hidden=8, lr=0.05, epochs=40, dropout=0.0)
    out = GM.predict_graphs(nodes, edges, model).join(graphs, "graph_id")
    assert model["history"][-1][1] < model["history"][0][1]
    assert out.where("prediction = label").count() > 0.9 * out.count()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in out.collect())
