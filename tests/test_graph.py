"""Graph operators on tiny hand-made graphs."""

import numpy as np
from pyspark.sql import functions as F

from loghawk.operators import graph as GR


def _nodes(spark, feats):
    return spark.createDataFrame([(i, [float(x) for x in f]) for i, f in enumerate(feats)],
                                 "node_id long, features array<double>")


def test_attention_softmax_sums_to_one(spark):
    nodes = _nodes(spark, [[1, 0], [0, 1], [1, 1], [2, -1]])
    edges = spark.createDataFrame([(0, 1), (2, 1), (3, 1), (1, 0), (0, 0)], "src long, dst long")
    w = GR.init_attention(2, 3, 2, seed=1)
    a = GR.attention_weights(nodes, edges, w)
    sums = a.groupBy("dst").agg(F.sum(F.col("alpha")[0]).alias("s0"), F.sum(F.col("alpha")[1]).alias("s1")).collect()
    for r in sums:
        assert abs(r.s0 - 1) < 1e-12 and abs(r.s1 - 1) < 1e-12
    out = GR.attend(nodes, edges, w).orderBy("node_id").collect()
    assert len(out) == 4 and len(out[0].features) == 6


def test_attention_matches_numpy(spark):
    feats = [[1.0, 0.5], [0.0, 1.0], [2.0, -1.0]]
    nodes = _nodes(spark, feats)
    edges = spark.createDataFrame([(0, 1), (2, 1), (1, 0)], "src long, dst long")
    w = GR.init_attention(2, 2, 2, seed=3)
    got = {r.node_id: np.array(r.features) for r in GR.attend(nodes, edges, w, activation=None).collect()}
    X = np.array(feats)
    inn = {0: [1, 0], 1: [0, 2, 1], 2: [2]}      # with self loops
    for i, srcs in inn.items():
        outs = []
        for h in range(2):
            P = X @ w["W"][h]
            e = np.array([P[j] @ w["att_src"][h] + P[i] @ w["att_dst"][h] for j in srcs])
            e = np.where(e > 0, e, 0.2 * e)
            a = np.exp(e - e.max()); a /= a.sum()
            outs.append((a[:, None] * P[srcs]).sum(0))
        assert np.allclose(got[i], np.concatenate(outs))


def test_k_hop_mean_isolated_and_repeated(spark):
    nodes = _nodes(spark, [[1, 2], [3, 4], [5, 6]])
    edges = spark.createDataFrame([(0, 1), (0, 1), (2, 1)], "src long, dst long")
    out = {r.node_id: r.features for r in GR.k_hop_mean(nodes, edges, 1).collect()}
    assert np.allclose(out[1], [(1 + 1 + 5) / 3, (2 + 2 + 6) / 3])
    assert out[0] == [0.0, 0.0] and out[2] == [0.0, 0.0]


def test_graph_stats_self_loop_and_repeats(spark):
    nodes = _nodes(spark, [[0], [0], [0]])
    edges = spark.createDataFrame([(0, 1), (1, 0), (0, 1), (2, 2)], "src long, dst long")
    r = GR.graph_stats(nodes, edges).first()
    assert r.nodes == 3 and r.edge_rows == 4 and r.edges == 2 and abs(r.density - 2 * 2 / 6) < 1e-12


def test_pool_add_mean(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "graph_id int, features array<double>")
    add = {r.graph_id: r.pooled for r in GR.pool(df, "add").collect()}
    mean = {r.graph_id: r.pooled for r in GR.pool(df, "mean").collect()}
    assert add[0] == [4.0, 6.0] and mean[0] == [2.0, 3.0] and add[1] == [5.0, 6.0]


def test_sequential_edges_per_group(spark):
    rows = [(i, "hot" if i % 4 else "cold", i * 10) for i in range(40)]
    df = spark.createDataFrame(rows, "log_id long, ip_address string, t long")
    e = GR.sequential_edges(df, ["t", "log_id"], partition=["ip_address"]).collect()
    pairs = {(r.src, r.dst) for r in e}
    assert (1, 2) in pairs and (2, 1) in pairs and (3, 5) in pairs and (0, 4) in pairs
    assert (3, 4) not in pairs
    assert len(e) == 2 * (40 - 2)


def test_graph_error_fits_linear_relation(spark):
    # features of each node are exactly 2 x its single neighbour's features + 1
    nodes = _nodes(spark, [[1.0], [3.0], [7.0], [15.0]])
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    err = {r.node_id: r.graph_error for r in GR.graph_error(nodes, edges, ridge=1e-9).collect()}
    assert all(err[i] < 1e-6 for i in (1, 2, 3))


def test_attention_stack_residual_and_norm(spark):
    nodes = _nodes(spark, [[1, 0], [0, 1], [1, 1], [2, -1]])
    edges = spark.createDataFrame([(0, 1), (2, 1), (3, 1), (1, 0), (1, 2), (1, 3)], "src long, dst long")
    layers = [GR.init_attention(2, 2, 2, seed=1), GR.init_attention(4, 4, 1, seed=2)]
    out = GR.attention_stack(nodes, edges, layers, residual=True, use_batch_norm=True)
    rows = {r.node_id: np.array(r.features) for r in out.collect()}
    assert len(rows) == 4 and all(v.shape == (4,) for v in rows.values())
    # residual: the second layer is 4 wide, the stack's input 2: nothing is added
    bn = GR.batch_norm(GR.attend(GR.attend(nodes, edges, layers[0], activation=None).transform(GR.batch_norm)
                                 .withColumn("features", F.transform("features", lambda v: F.when(v > 0, v).otherwise(F.exp(v) - 1))),
                                 edges, layers[1], activation=None))
    second = {r.node_id: np.array(r.features) for r in bn.collect()}
    for i in rows:
        elu = np.where(second[i] > 0, second[i], np.exp(second[i]) - 1)
        assert np.allclose(rows[i], elu, atol=1e-9)


def test_attention_stack_adds_the_input_where_widths_match(spark):
    nodes = _nodes(spark, [[1, 0], [0, 1], [1, 1], [2, -1]])
    edges = spark.createDataFrame([(0, 1), (2, 1), (3, 1), (1, 0), (1, 2), (1, 3)], "src long, dst long")
    layers = [GR.init_attention(2, 2, 1, seed=s) for s in (1, 2, 3)]
    vec = lambda df: {r.node_id: np.array(r.features) for r in df.collect()}
    x, got = vec(nodes.select("node_id", "features")), vec(GR.attention_stack(nodes, edges, layers, residual=True))
    one = GR.attend(nodes, edges, layers[0])
    two = vec(GR.attend(one, edges, layers[1]))
    summed = {i: two[i] + x[i] for i in x}
    three = vec(GR.attend(_nodes(spark, [summed[i].tolist() for i in range(4)]), edges, layers[2]))
    assert all(np.allclose(got[i], three[i] + summed[i], atol=1e-9) for i in x)
