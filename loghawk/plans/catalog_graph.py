"""Registered graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loghawk.operators import features as FE
from loghawk.operators import graph as GR
from loghawk.operators import graph_model as GM
from loghawk.operators import graph_search as GS
from loghawk.operators.scaling import split_cut
from loghawk.plans.preprocess import ZSCORE_FEATURES, zscore_scored
from loghawk.plans.registry import (SQL_FEATURE_EXPRS, SQL_FEATURES_CTE, finish, register, sql_finish,
                                    sql_zscore_ctes, with_log)
from loghawk.plans.sql_nets import attention_ctes, given_weights, head_ctes, normalised_ctes, trained_weights
from loghawk.sources.tables import api_log, read_table

_GCOLS = ["response_ms", "status_code", "request_time_hour"]
_F = [f"f{i}" for i in range(len(_GCOLS))]


def _flat(df, col="features", d=len(_GCOLS), prefix="f"):
    return df.select(*[c for c in df.columns if c != col], *[F.col(col)[i].alias(f"{prefix}{i}") for i in range(d)])


def _log(spark, sf):
    return FE.time_features(api_log(spark, sf), "request_time")


# SQL: node ids, node features and edges of the IP-endpoint graph
_G_SQL = (
    " , l AS (SELECT *, " + SQL_FEATURE_EXPRS["request_time_hour"] + " AS request_time_hour FROM api_log)"
    ", ipn AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS node_id FROM"
    " (SELECT DISTINCT ip_address AS key FROM api_log WHERE ip_address IS NOT NULL))"
    ", epn AS (SELECT key, row_number() OVER (ORDER BY key) - 1 + (SELECT count(*) FROM ipn) AS node_id FROM"
    " (SELECT DISTINCT endpoint AS key FROM api_log WHERE endpoint IS NOT NULL))"
    ", nodes AS (SELECT node_id, 'ip' AS kind, key FROM ipn UNION ALL SELECT node_id, 'endpoint', key FROM epn)"
    ", edges AS (SELECT ipn.node_id AS src, epn.node_id AS dst FROM api_log a JOIN ipn ON a.ip_address = ipn.key"
    " JOIN epn ON a.endpoint = epn.key UNION ALL SELECT epn.node_id, ipn.node_id FROM api_log a"
    " JOIN ipn ON a.ip_address = ipn.key JOIN epn ON a.endpoint = epn.key)"
    ", nf AS (SELECT ipn.node_id, " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS f{i}" for i, c in enumerate(_GCOLS))
    + " FROM l JOIN ipn ON l.ip_address = ipn.key GROUP BY 1 UNION ALL SELECT epn.node_id, "
    + ", ".join(f"avg(CAST({c} AS DOUBLE))" for c in _GCOLS) + " FROM l JOIN epn ON l.endpoint = epn.key GROUP BY 1)")


def _graph(spark, sf):
    log = _log(spark, sf)
    nodes = GR.bipartite_nodes(log)
    edges = GR.bipartite_edges(log, nodes)
    feats = GR.node_features(log, nodes, _GCOLS)
    return log, nodes, edges, feats


@register("graph_sequential_edges", with_log(
    " , s AS (SELECT log_id AS a, lead(log_id) OVER (ORDER BY request_time, log_id) AS b FROM api_log)"
    " SELECT a AS src, b AS dst FROM s WHERE b IS NOT NULL UNION ALL SELECT b, a FROM s WHERE b IS NOT NULL"))
def q_seq(spark, sf):
    return GR.sequential_edges(api_log(spark, sf), ["request_time", "log_id"])


@register("graph_sequential_edges_per_ip", with_log(
    " , s AS (SELECT log_id AS a, lead(log_id) OVER (PARTITION BY ip_address ORDER BY request_time, log_id) AS b"
    " FROM api_log) SELECT a AS src, b AS dst FROM s WHERE b IS NOT NULL UNION ALL SELECT b, a FROM s WHERE b IS NOT NULL"))
def q_seq_ip(spark, sf):
    return GR.sequential_edges(api_log(spark, sf), ["request_time", "log_id"], partition=["ip_address"])


@register("graph_bipartite_nodes", with_log(_G_SQL + " SELECT CAST(node_id AS BIGINT) AS node_id, kind, key FROM nodes"))
def q_nodes(spark, sf):
    return GR.bipartite_nodes(api_log(spark, sf))


@register("graph_bipartite_edges", with_log(_G_SQL + " SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM edges"))
def q_edges(spark, sf):
    log = api_log(spark, sf)
    return GR.bipartite_edges(log, GR.bipartite_nodes(log))


@register("graph_node_features", sql_finish(with_log(
    _G_SQL + " SELECT CAST(n.node_id AS BIGINT) AS node_id, n.kind, n.key, f0, f1, f2 FROM nodes n JOIN nf ON n.node_id = nf.node_id"),
    doubles=_F, others=["node_id", "kind", "key"]))
def q_node_features(spark, sf):
    _, _, _, feats = _graph(spark, sf)
    return finish(_flat(feats))


@register("graph_stats", sql_finish(with_log(
    _G_SQL + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edge_rows,"
    " (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM edges)) AS edges,"
    " 2.0 * (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM edges))"
    " / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)) AS density"),
    doubles=["density"], others=["nodes", "edge_rows", "edges"]))
def q_stats(spark, sf):
    _, nodes, edges, _ = _graph(spark, sf)
    return finish(GR.graph_stats(nodes, edges))


def _hop_sql(src: str, dst: str) -> str:
    return (f", {dst} AS (SELECT e.dst AS node_id, " + ", ".join(f"avg(n.f{i}) AS f{i}" for i in range(len(_GCOLS)))
            + f" FROM edges e JOIN {src} n ON e.src = n.node_id GROUP BY 1)")


@register("graph_k_hop_mean", sql_finish(with_log(
    _G_SQL + _hop_sql("nf", "r1") + _hop_sql("r1", "r2")
    + " SELECT CAST(n.node_id AS BIGINT) AS node_id, " + ", ".join(f"COALESCE(r2.f{i}, 0.0) AS f{i}" for i in range(len(_GCOLS)))
    + " FROM nodes n LEFT JOIN r2 ON n.node_id = r2.node_id"), doubles=_F, others=["node_id"]))
def q_khop(spark, sf):
    _, _, edges, feats = _graph(spark, sf)
    return finish(_flat(GR.k_hop_mean(feats, edges, 2, dim=len(_GCOLS))))


_EMB = 64


def _pool_sql(how: str) -> str:
    f = "sum" if how == "add" else "avg"
    return ("SELECT label AS graph_id, " + ", ".join(f"{f}(CAST(embedding[{i + 1}] AS DOUBLE)) AS p{i}" for i in range(_EMB))
            + " FROM embeddings GROUP BY label")


def _pool(spark, sf, how):
    emb = read_table(spark, sf, "embeddings").select(F.col("label").alias("graph_id"),
                                                     F.col("embedding").alias("features"))
    return finish(_flat(GR.pool(emb, how, dim=_EMB), "pooled", _EMB, "p"))


@register("graph_pool_add", sql_finish(_pool_sql("add"), doubles=[f"p{i}" for i in range(_EMB)], others=["graph_id"]))
def q_pool_add(spark, sf):
    """Embeddings as node vectors, one graph per label."""
    return _pool(spark, sf, "add")


@register("graph_pool_mean", sql_finish(_pool_sql("mean"), doubles=[f"p{i}" for i in range(_EMB)], others=["graph_id"]))
def q_pool_mean(spark, sf):
    return _pool(spark, sf, "mean")


def _scaled_feats(feats):
    """Node features are raw means; z-score them per position for attention."""
    from loghawk.operators.scaling import apply_scaler, fit_scaler
    flat = _flat(feats)
    sc = fit_scaler(flat, _F).collect()
    z = apply_scaler(flat, sc)
    return z.select("node_id", "kind", "key", F.array(*_F).alias("features"))


@register("graph_attention")
def q_attention(spark, sf):
    """One attention layer (4 heads x 8 channels, ELU) over the IP-endpoint graph."""
    _, _, edges, feats = _graph(spark, sf)
    nodes = _scaled_feats(feats)
    w = GR.init_attention(len(_GCOLS), 8, 4, seed=7)
    return GR.attend(nodes, edges, w)


_W, _AS, _AD, _B = (0.5, -0.25, 0.75), 0.6, -0.4, 0.1
_Z_SQL = (", q AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_F)) + " FROM nf)"
          ", z AS (SELECT node_id, " + " + ".join(f"({w!r}) * (nf.{c} - m{i}) / s{i}" for i, (w, c) in enumerate(zip(_W, _F))) + " AS p FROM nf, q)")


@register("graph_attention_fixed_weights", sql_finish(with_log(
    _G_SQL + _Z_SQL + ", e AS (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT node_id, node_id FROM nodes)"
    f", r AS (SELECT e.dst, a.p, ({_AS!r}) * a.p + ({_AD!r}) * b.p AS raw FROM e JOIN z a ON e.src = a.node_id JOIN z b ON e.dst = b.node_id)"
    ", x AS (SELECT dst, p, CASE WHEN raw > 0 THEN raw ELSE 0.2 * raw END AS s FROM r)"
    ", m AS (SELECT dst, max(s) AS top FROM x GROUP BY dst)"
    f", o AS (SELECT x.dst AS node_id, sum(exp(s - top) * p) / sum(exp(s - top)) + {_B!r} AS v FROM x JOIN m ON x.dst = m.dst GROUP BY 1)"
    " SELECT CAST(node_id AS BIGINT) AS node_id, CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END AS out0 FROM o"),
    doubles=["out0"], others=["node_id"]))
def q_attention_fixed(spark, sf):
    """One head of width one with given weights: the layer's arithmetic against SQL."""
    import numpy as np
    _, _, edges, feats = _graph(spark, sf)
    w = {"W": np.array(_W).reshape(1, 3, 1), "att_src": np.array([[_AS]]), "att_dst": np.array([[_AD]]), "bias": np.array([_B])}
    return finish(_flat(GR.attend(_scaled_feats(feats), edges, w), d=1, prefix="out"))


def _given_layer(d_in: int, d_out: int, heads: int, first: int = 0) -> dict:
    """Given weights of an attention layer, cut from one line of numbers."""
    import numpy as np
    line = np.array(given_weights(first + heads * (d_in * d_out + 3 * d_out)))[first:]
    cut = np.split(line, np.cumsum([heads * d_in * d_out, heads * d_out, heads * d_out]))
    return {"W": cut[0].reshape(heads, d_in, d_out), "att_src": cut[1].reshape(heads, d_out), "att_dst": cut[2].reshape(heads, d_out), "bias": cut[3]}


_ZF_SQL = (", q AS (SELECT " + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_F)) + " FROM nf)"
           ", z0 AS MATERIALIZED (SELECT node_id, " + ", ".join(f"(nf.{c} - m{i}) / s{i} AS {c}" for i, c in enumerate(_F)) + " FROM nf, q)"
           ", e0 AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT node_id, node_id FROM nodes)")
_TWO = _given_layer(3, 2, 2)


@register("graph_attention_two_heads", sql_finish(with_log(
    _G_SQL + _ZF_SQL + attention_ctes("z0", "o", "e0", _TWO) + " SELECT CAST(node_id AS BIGINT) AS node_id, f0, f1, f2, f3 FROM o"),
    doubles=["f0", "f1", "f2", "f3"], others=["node_id"]))
def q_attention_two(spark, sf):
    """Two heads of width two with given weights."""
    _, _, edges, feats = _graph(spark, sf)
    return finish(_flat(GR.attend(_scaled_feats(feats), edges, _TWO), d=4))


_STACK = [_TWO, _given_layer(4, 3, 1, first=5)]


@register("graph_attention_stack_given_weights", sql_finish(with_log(
    _G_SQL + _ZF_SQL + attention_ctes("z0", "a1", "e0", _STACK[0], False) + normalised_ctes("a1", "b1", 4)
    + attention_ctes("b1", "a2", "e0", _STACK[1], False) + normalised_ctes("a2", "b2", 3)
    + ", kept AS (SELECT node_id, " + ", ".join(f"b2.{c} + z0.{c} AS {c}" for c in _F) + " FROM b2 JOIN z0 USING (node_id))"
    " SELECT kind AS graph_id, " + ", ".join(f"avg({c}) AS {c}" for c in _F) + " FROM kept JOIN nodes USING (node_id) GROUP BY kind"),
    doubles=_F, others=["graph_id"]))
def q_stack_given(spark, sf):
    """Two layers (two heads of width two, one of width three) with batch norm and
    residual, then the mean by kind of node; given weights."""
    _, _, edges, feats = _graph(spark, sf)
    nodes = _scaled_feats(feats)
    out = GR.attention_stack(nodes, edges, _STACK, residual=True, use_batch_norm=True)
    return finish(_flat(GR.pool(out.join(nodes.select("node_id", F.col("kind").alias("graph_id")), "node_id"), "mean", dim=3), "pooled"))


_GCN = [_given_layer(3, 4, 1)["W"][0], _given_layer(4, 2, 1, first=3)["W"][0]]


def _gcn_sql(src: str, dst: str, w) -> str:
    d_in, d_out = w.shape
    out = [" + ".join(f"({float(w[i, j])!r}) * sum(n.f{i} / (sqrt(a.deg) * sqrt(b.deg)))" for i in range(d_in)) + f" AS v{j}" for j in range(d_out)]
    act = ", ".join(f"CASE WHEN v{j} > 0 THEN v{j} ELSE exp(v{j}) - 1 END AS f{j}" for j in range(d_out))
    return (f", {dst}_ AS (SELECT e.dst AS node_id, {', '.join(out)} FROM e0 e JOIN {src} n ON e.src = n.node_id"
            f" JOIN deg a ON e.src = a.node_id JOIN deg b ON e.dst = b.node_id GROUP BY e.dst), {dst} AS MATERIALIZED (SELECT node_id, {act} FROM {dst}_)")


@register("graph_convolution", sql_finish(with_log(
    _G_SQL + _ZF_SQL + ", deg AS MATERIALIZED (SELECT dst AS node_id, count(*) AS deg FROM e0 GROUP BY dst)" + _gcn_sql("z0", "c1", _GCN[0]) + _gcn_sql("c1", "c2", _GCN[1])
    + " SELECT CAST(node_id AS BIGINT) AS node_id, f0, f1 FROM c2"), doubles=["f0", "f1"], others=["node_id"]))
def q_convolution(spark, sf):
    """Two convolution layers over the IP-endpoint graph, repeats as weights; given weights."""
    _, _, edges, feats = _graph(spark, sf)
    return finish(_flat(GR.convolve(GR.convolve(_scaled_feats(feats), edges, _GCN[0]), edges, _GCN[1]), d=2))


@register("graph_error_one_feature", sql_finish(with_log(
    _G_SQL + _hop_sql("nf", "r1") + ", d AS (SELECT nf.node_id, nf.f0 AS x, r1.f0 AS h FROM nf JOIN r1 ON nf.node_id = r1.node_id)"
    ", t AS (SELECT sum(h * h) + 0.001 AS a, sum(h) AS b, count(*) + 0.001 AS c, sum(h * x) AS u, sum(x) AS v FROM d)"
    ", s AS (SELECT (c * u - b * v) / (a * c - b * b) AS w, (a * v - b * u) / (a * c - b * b) AS i FROM t)"
    " SELECT CAST(node_id AS BIGINT) AS node_id, (x - (w * h + i)) ^ 2 AS graph_error FROM d, s"),
    doubles=["graph_error"], others=["node_id"]))
def q_graph_error_one(spark, sf):
    """The graph reconstruction error with one feature, whose head has a closed form."""
    _, _, edges, feats = _graph(spark, sf)
    one = feats.select("node_id", F.slice("features", 1, 1).alias("features"))
    return finish(GR.graph_error(one, edges))


@register("graph_attention_stack_pooled")
def q_attention_stack(spark, sf):
    """Two attention layers (4 heads x 8, then 1 head x 8) with batch norm and
    residual, then mean pooling per node kind."""
    _, _, edges, feats = _graph(spark, sf)
    nodes = _scaled_feats(feats)
    layers = [GR.init_attention(len(_GCOLS), 8, 4, seed=11), GR.init_attention(32, 8, 1, seed=12)]
    out = GR.attention_stack(nodes, edges, layers, residual=True, use_batch_norm=True)
    return GR.pool(out.join(nodes.select("node_id", F.col("kind").alias("graph_id")), "node_id"), "mean")


@register("graph_reconstruction_error")
def q_graph_error(spark, sf):
    _, _, edges, feats = _graph(spark, sf)
    return GR.graph_error(_scaled_feats(feats), edges)


@register("graph_labelled_tables", sql_finish(with_log(
    _G_SQL + ", bad AS (SELECT ip_address AS key, CAST(max(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) AS INTEGER)"
    " AS label FROM api_log GROUP BY 1)"
    " SELECT CAST(n.node_id AS BIGINT) AS node_id, n.kind, n.key, COALESCE(bad.label, -1) AS label, nf.f0, nf.f1, nf.f2 FROM nodes n"
    " JOIN nf ON n.node_id = nf.node_id LEFT JOIN bad ON n.key = bad.key"),
    doubles=_F, others=["node_id", "kind", "key", "label"]))
def q_graph_tables(spark, sf):
    """IP nodes labelled 1 when any of their requests was a server error
    (else 0); endpoint nodes carry no label (shown as -1)."""
    log, nodes, edges, feats = _graph(spark, sf)
    bad = (log.groupBy("ip_address").agg(F.max((F.col("status_code") >= 500).cast("int")).alias("label"))
           .withColumnRenamed("ip_address", "key"))
    labels = nodes.join(bad, "key").select("node_id", "label")
    n, _ = GR.graph_tables(feats, edges, labels)
    return finish(_flat(n).withColumn("label", F.coalesce("label", F.lit(-1))))   # -1: unlabelled node


@register("graph_combined_score", sql_finish(with_log(
    SQL_FEATURES_CTE + sql_zscore_ctes(ZSCORE_FEATURES)
    + ", m AS (SELECT ip_address, " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}" for i, c in enumerate(_GCOLS))
    + " FROM f GROUP BY 1)"
    ", g AS (SELECT f.log_id, (" + " + ".join(f"(CAST(f.{c} AS DOUBLE) - m.m{i}) ^ 2" for i, c in enumerate(_GCOLS))
    + f") / {float(len(_GCOLS))} AS graph_score FROM f JOIN m ON f.ip_address = m.ip_address)"
    " SELECT z.log_id, z.reconstruction_error, g.graph_score,"
    " 0.5 * z.reconstruction_error + 0.5 * g.graph_score AS combined_score FROM z JOIN g ON z.log_id = g.log_id"),
    doubles=["reconstruction_error", "graph_score", "combined_score"], others=["log_id"]))
def q_combined(spark, sf):
    """Autoencoder-style error (z-score) combined with a graph score: how far
    a request lies from its IP node's mean feature vector."""
    log = _log(spark, sf)
    means = GR.vector_mean_by(log, "ip_address", _GCOLS, "m")
    x = F.array(*[F.col(c).cast("double") for c in _GCOLS])
    g = (log.select("log_id", "ip_address", x.alias("x")).join(means, "ip_address")
         .select("log_id", (F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                        lambda s, v: s + v) / len(_GCOLS)).alias("graph_score")))
    return finish(GR.combined_score(zscore_scored(api_log(spark, sf)), g, 0.5))


# ---- graphs of an IP's day, classified ----
_DAY_LAYER, _DAY_HIDDEN, _DAY_STEPS, _DAY_RATE, _DAY_DECAY = _given_layer(2, 2, 2), 3, 2, 0.02, 0.001
_DAY_INIT = given_weights(_DAY_HIDDEN * 4 + _DAY_HIDDEN + 2 * _DAY_HIDDEN + 2)
_DAY_SQL = with_log(
    ", l AS (SELECT *, CAST(request_time AS DATE) AS day, (CAST(response_ms AS DOUBLE) - 50) / 30 AS f0, (hour(request_time) - 12) / 6.0::DOUBLE AS f1 FROM api_log)"
    ", g AS (SELECT row_number() OVER (ORDER BY ip_address, day) - 1 AS graph_id, ip_address, day, CAST(max(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) AS INTEGER) AS y"
    " FROM l GROUP BY ip_address, day)"
    ", z0 AS MATERIALIZED (SELECT log_id AS node_id, f0, f1, graph_id, lead(log_id) OVER (PARTITION BY graph_id ORDER BY request_time, log_id) AS nxt FROM l JOIN g USING (ip_address, day))"
    ", e0 AS MATERIALIZED (SELECT node_id AS src, nxt AS dst FROM z0 WHERE nxt IS NOT NULL UNION ALL SELECT nxt, node_id FROM z0 WHERE nxt IS NOT NULL UNION ALL SELECT node_id, node_id FROM z0)"
    + attention_ctes("z0", "o", "e0", _DAY_LAYER)
    + ", x AS MATERIALIZED (SELECT g.graph_id, any_value(y) AS y, " + ", ".join(f"avg(o.f{i}) AS x{i}" for i in range(4)) + " FROM o JOIN z0 USING (node_id) JOIN g USING (graph_id) GROUP BY g.graph_id)")
_DAY_CTES, _DAY_N = head_ctes(4, _DAY_HIDDEN, 2, _DAY_INIT, _DAY_STEPS, _DAY_RATE, _DAY_DECAY)


def _day_graphs(spark, sf):
    log = _log(spark, sf).withColumn("day", F.to_date("request_time"))
    scaled = [(F.col("response_ms").cast("double") - 50) / 30, (F.col("request_time_hour") - 12) / F.lit(6.0)]
    return GM.graph_batch(log, scaled, ["ip_address", "day"], (F.col("status_code") >= 500).cast("int"))


def _day_model(spark, sf):
    nodes, edges, graphs = _day_graphs(spark, sf)
    model = GM.fit_graph_classifier(nodes, edges, graphs, [_DAY_LAYER], "mean", hidden=_DAY_HIDDEN, lr=_DAY_RATE, epochs=_DAY_STEPS, dropout=0.0,
                                    weight_decay=_DAY_DECAY, init=_DAY_INIT)
    return nodes, edges, graphs, model


@register("graph_classifier_given_weights", sql_finish(trained_weights(_DAY_SQL + _DAY_CTES, _DAY_N, _DAY_STEPS), doubles=["weight"], others=["position"]))
def q_graph_classifier(spark, sf):
    """A graph for each IP and day: attention, pooling and the head as one plan; the
    head after two steps of Adam from given weights (CL1)."""
    model = _day_model(spark, sf)[3]
    return finish(spark.createDataFrame([(k, float(w)) for k, w in enumerate(model["weights"])], "position long, weight double"))


@register("graph_classifier_history", sql_finish(_DAY_SQL + _DAY_CTES + " " + " UNION ALL ".join(f"SELECT {t} AS epoch, loss, accuracy FROM l{t}" for t in range(_DAY_STEPS)),
                                                 doubles=["loss", "accuracy"], others=["epoch"]))
def q_graph_classifier_history(spark, sf):
    """Loss and accuracy of these steps."""
    return finish(spark.createDataFrame(_day_model(spark, sf)[3]["history"], "epoch int, loss double, accuracy double"))


@register("graph_classifier_predictions", sql_finish(_DAY_SQL + _DAY_CTES + f" SELECT graph_id, y AS label, CAST(best AS INTEGER) AS prediction, q0, q1 FROM f{_DAY_STEPS}_",
                                                     doubles=["q0", "q1"], others=["graph_id", "label", "prediction"]))
def q_graph_classifier_predictions(spark, sf):
    """That model's class probabilities of every graph (CL2)."""
    nodes, edges, graphs, model = _day_model(spark, sf)
    out = GM.predict_graphs(nodes, edges, model).join(graphs.select("graph_id", "label"), "graph_id")
    return finish(out.select("graph_id", "label", "prediction", F.col("probabilities")[0].alias("q0"), F.col("probabilities")[1].alias("q1")))


@register("graph_model_search")
def q_graph_search(spark, sf):
    """20 trials over all nine parameters on the graphs of an IP's day, in one pass; a fifth is held out (CL8)."""
    nodes, edges, graphs = _day_graphs(spark, sf)
    held = F.substring(F.md5(F.col("graph_id").cast("string")), 1, 8) < split_cut(0.2)
    return GS.search_graph_model(nodes, edges, graphs, held, n_trials=20)[0]
