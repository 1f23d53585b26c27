"""Request graphs as two DataFrames: ``nodes(node_id, features array<double>,
...)`` and ``edges(src, dst)``; message passing as joins + aggregates.

Aggregation over a node's neighbours is always a hash aggregate keyed by the
destination with one ``sum``/``max`` per vector position, so partial
aggregation pre-combines a hot node (an endpoint hit by a third of all
requests) in every task before the shuffle.  No per-node group is ever
materialised in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk.plans.joins import lookup_join
from loghawk.plans.ordered import with_global_index, with_successor
from loghawk.plans.vector_sum import partition_sums
from loghawk.session import cut_lineage


def _dim(df: DataFrame, col: str = "features") -> int:
    row = df.select(F.size(col).alias("n")).where(F.col("n") >= 0).first()
    return int(row["n"]) if row else 0


# ------------------------------------------------------------------- edges ----
def sequential_edges(df: DataFrame, order: list[str] = ("request_time", "log_id"), partition: list[str] | None = None,
                     id_col: str = "log_id") -> DataFrame:
    """Consecutive rows linked both ways.  File order has no meaning in Spark,
    so rows are ordered by ``order`` (must end with a unique id), optionally
    within ``partition`` groups (e.g. per IP).  The successor of each row
    comes from a range-partitioned sort (hot groups are split over tasks)
    instead of a per-group ``lead`` window, which would put a hot IP's rows
    in one task."""
    partition = list(partition or [])
    keys = partition + list(order)
    succ = with_successor(df.select(*dict.fromkeys(keys + [id_col])), keys, [id_col] + partition)
    pairs = succ.where(F.col("next_" + id_col).isNotNull())
    for p in partition:
        pairs = pairs.where(F.col(p).eqNullSafe(F.col("next_" + p)))
    a, b = F.col(id_col), F.col("next_" + id_col)
    both = F.explode(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst"))))
    return pairs.select(both.alias("e")).select("e.src", "e.dst")


def bipartite_nodes(df: DataFrame, ip: str = "ip_address", endpoint: str = "endpoint") -> DataFrame:
    """``(node_id, kind, key)``: IPs get ids 0..n-1 in sorted order, endpoints
    n.. after them -- one distributed global index over the distinct keys
    ordered by (kind, key), never a collected dictionary."""
    pairs = F.explode(F.array(F.struct(F.lit(0).alias("__k"), F.col(ip).alias("key")),
                              F.struct(F.lit(1).alias("__k"), F.col(endpoint).alias("key"))))
    keys = (df.select(pairs.alias("p")).select("p.*")         # one scan of the log
            .where(F.col("key").isNotNull()).distinct())
    idx = with_global_index(keys, ["__k", "key"], "node_id")
    return idx.select("node_id", F.when(F.col("__k") == 0, "ip").otherwise("endpoint").alias("kind"), "key")


def bipartite_edges(df: DataFrame, nodes: DataFrame, ip: str = "ip_address", endpoint: str = "endpoint",
                    id_col: str | None = None) -> DataFrame:
    """Two directed edges per log row (IP -> endpoint, endpoint -> IP); repeats
    kept.  Rows with a NULL IP or endpoint give no edge."""
    ipn = nodes.where(F.col("kind") == "ip").select(F.col("key").alias(ip), F.col("node_id").alias("__ipn"))
    epn = nodes.where(F.col("kind") == "endpoint").select(F.col("key").alias(endpoint), F.col("node_id").alias("__epn"))
    cols = [ip, endpoint] + ([id_col] if id_col else [])
    j = lookup_join(lookup_join(df.select(*cols), ipn, ip, "inner"), epn, endpoint, "inner")
    extra = [F.col(id_col)] if id_col else []
    both = F.explode(F.array(F.struct(F.col("__ipn").alias("src"), F.col("__epn").alias("dst"), *extra),
                             F.struct(F.col("__epn").alias("src"), F.col("__ipn").alias("dst"), *extra)))
    return j.select(both.alias("e")).select("e.*")


# ---------------------------------------------------------------- features ----
def vector_mean_by(df: DataFrame, key: str | list[str], cols: list[str], out: str = "features") -> DataFrame:
    """Per key: the mean of each feature column, as an ordered array."""
    keys = [key] if isinstance(key, str) else list(key)
    agg = df.groupBy(*keys).agg(*[F.avg(F.col(c).cast("double")).alias(f"__m{i}") for i, c in enumerate(cols)])
    return agg.select(*keys, F.array(*[F.col(f"__m{i}") for i in range(len(cols))]).alias(out))


def node_features(df: DataFrame, nodes: DataFrame, cols: list[str], ip: str = "ip_address",
                  endpoint: str = "endpoint") -> DataFrame:
    """Bipartite node features: the mean feature vector of each IP's and each
    endpoint's requests (the rows really behind the node), both kinds from
    one scan (grouping sets ``(ip)`` and ``(endpoint)``)."""
    agg = df.groupingSets([[ip], [endpoint]], ip, endpoint).agg(
        F.grouping(ip).alias("__gi"), *[F.avg(F.col(c).cast("double")).alias(f"__m{i}") for i, c in enumerate(cols)])
    feats = agg.select(F.when(F.col("__gi") == 0, "ip").otherwise("endpoint").alias("kind"),
                       F.when(F.col("__gi") == 0, F.col(ip)).otherwise(F.col(endpoint)).alias("key"),
                       F.array(*[F.col(f"__m{i}") for i in range(len(cols))]).alias("features"))
    return nodes.join(feats, ["kind", "key"], "left").select("node_id", "kind", "key", "features")


def graph_tables(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Check the two tables and attach an optional ``(node_id, label)``."""
    for name, df, need in (("nodes", nodes, ["node_id", "features"]), ("edges", edges, ["src", "dst"])):
        miss = [c for c in need if c not in df.columns]
        if miss:
            raise ValueError(f"{name} lacks {miss}")
    if labels is not None:
        nodes = nodes.join(labels.select("node_id", "label"), "node_id", "left")
    return nodes, edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, directed edge rows, simple undirected edges (self
    loops count once), density 2m / (n (n - 1))."""
    n = nodes.select(F.count(F.lit(1)).alias("nodes"))
    undirected = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    rows = edges.agg(F.count(F.lit(1)).alias("edge_rows"))
    m = undirected.agg(F.count(F.lit(1)).alias("edges"))
    nn, er, mm = n.select("nodes").scalar(), rows.select("edge_rows").scalar(), m.select("edges").scalar()
    return nodes.sparkSession.range(1).select(
        nn.alias("nodes"), er.alias("edge_rows"), mm.alias("edges"),
        F.when(nn > 1, 2.0 * mm / (nn * (nn - 1))).otherwise(F.lit(0.0)).alias("density"))


# --------------------------------------------------------- message passing ----
def _sum_positions(col: str, d: int, prefix: str) -> list[Column]:
    return [F.sum(F.col(col)[i]).alias(f"{prefix}{i}") for i in range(d)]


def compact_edges(edges: DataFrame) -> DataFrame:
    """Repeated edges become one ``(src, dst, weight)`` row (partial aggregate):
    a log repeats each (IP, endpoint) pair many times, so message passing
    over the compacted table moves far fewer rows and the same sums."""
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def k_hop_mean(nodes: DataFrame, edges: DataFrame, k: int = 1, features: str = "features",
               checkpoint_each: bool = True, dim: int | None = None, cut_every: int = 3) -> DataFrame:
    """Mean of in-neighbour features, ``k`` times (repeated edges weigh more);
    a node without in-edges gets zeros.  Edges are compacted to weights and
    written once to the checkpoint folder (they are reused every round); each
    round joins them with the current features on src and aggregates by dst
    (partial weighted sums per position).  With ``checkpoint_each`` the
    features are written there every ``cut_every`` rounds, so the lineage
    never grows past ``cut_every`` rounds."""
    cur = nodes.select("node_id", features)
    w_edges = compact_edges(edges)
    if checkpoint_each and k > 1:
        w_edges = cut_lineage(w_edges)
    d = dim or _dim(cur, features)
    ids = cur.select("node_id")
    zeros = F.array(*[F.lit(0.0) for _ in range(d)])
    for r in range(k):
        feats = cur.withColumnRenamed("node_id", "src")
        msgs = w_edges.join(feats, "src")
        agg = msgs.groupBy(F.col("dst").alias("node_id")).agg(
            F.sum("weight").alias("__deg"),
            *[F.sum(F.col("weight") * F.col(features)[i]).alias(f"__s{i}") for i in range(d)])
        mean = agg.select("node_id", F.array(*[F.col(f"__s{i}") / F.col("__deg") for i in range(d)]).alias(features))
        cur = ids.join(mean, "node_id", "left").select("node_id", F.coalesce(F.col(features), zeros).alias(features))
        if checkpoint_each and (r + 1) % cut_every == 0 and r + 1 < k:
            cur = cut_lineage(cur)
    return cur


def pool(df: DataFrame, how: str = "add", graph_col: str = "graph_id", features: str = "features",
         dim: int | None = None) -> DataFrame:
    """Per graph: sum ('add') or mean ('mean') of node vectors."""
    if how not in ("add", "mean"):
        raise ValueError(f"Unsupported pooling method: {how}")
    d = dim or _dim(df, features)
    f = F.sum if how == "add" else F.avg
    agg = df.groupBy(graph_col).agg(*[f(F.col(features)[i].cast("double")).alias(f"__p{i}") for i in range(d)])
    return agg.select(graph_col, F.array(*[F.col(f"__p{i}") for i in range(d)]).alias("pooled"))


# --------------------------------------------------------------- attention ----
def init_attention(d_in: int, d_out: int, heads: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Glorot-uniform weights for one attention layer."""
    rng = np.random.default_rng(seed)
    lim_w = np.sqrt(6.0 / (d_in + heads * d_out))
    lim_a = np.sqrt(6.0 / (1 + d_out))
    return {"W": rng.uniform(-lim_w, lim_w, (heads, d_in, d_out)),
            "att_src": rng.uniform(-lim_a, lim_a, (heads, d_out)),
            "att_dst": rng.uniform(-lim_a, lim_a, (heads, d_out)),
            "bias": np.zeros(heads * d_out)}


def _project_udf(weights: dict[str, np.ndarray]):
    W, a_s, a_d = weights["W"], weights["att_src"], weights["att_dst"]
    H, _, D = W.shape
    schema = T.StructType([T.StructField("proj", T.ArrayType(T.DoubleType())),
                           T.StructField("a_src", T.ArrayType(T.DoubleType())),
                           T.StructField("a_dst", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(schema)
    def project(x: pd.Series) -> pd.DataFrame:
        X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, W.shape[1]))
        P = np.einsum("nd,hde->nhe", X, W)                     # n x H x D
        return pd.DataFrame({"proj": list(P.reshape(len(X), H * D)),
                             "a_src": list(np.einsum("nhe,he->nh", P, a_s)),
                             "a_dst": list(np.einsum("nhe,he->nh", P, a_d))})
    return project


#: Scores are cut into classes of this width; within one, exp() never leaves [1, e**SPAN).
SPAN = 32.0


def softmax_parts(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, h, v): per key and part ``h`` the softmax-weighted mean of vectors.

    ``rows``: (keys, h, weight, e, v): each row counts ``weight`` times, with the
    score ``e`` and the vector ``v`` of at most ``width`` numbers.  One aggregate that
    merges in any order: the sums of exp(e - SPAN * k) and of its products with
    the vector, by key, part and k = floor(e / SPAN), so no maximum is needed
    beforehand and a hot key is summed in every task.  A key's few classes are
    then brought to its highest one's scale."""
    k = F.floor(F.col("e") / SPAN)
    rows = rows.select(*keys, "h", k.alias("k"), (F.col("weight") * F.exp(F.col("e") - k * SPAN)).alias("x"), "v")
    parts = rows.groupBy(*keys, "h", "k").agg(F.sum("x").alias("s"), *[F.sum(F.col("x") * F.get("v", F.lit(j))).alias(f"n{j}") for j in range(width)])
    # a vector shorter than ``width`` has NULLs behind it
    n = F.filter(F.array(*[f"n{j}" for j in range(width)]), lambda v: v.isNotNull())
    parts = parts.select(*keys, "h", F.struct("k", "s", n.alias("n")).alias("part"))
    merged = parts.groupBy(*keys, "h").agg(F.collect_list("part").alias("parts"), F.max("part.k").alias("top"))
    scale = lambda p: F.exp((p["k"] - F.col("top")) * SPAN)
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + scale(p) * p["s"])
    zeros = F.transform(F.col("parts")[0]["n"], lambda v: F.lit(0.0))
    vector = F.aggregate("parts", zeros, lambda acc, p: F.zip_with(acc, p["n"], lambda x, y: x + scale(p) * y))
    mean = merged.select(*keys, "h", total.alias("total"), vector.alias("sum"))
    return mean.select(*keys, "h", F.transform("sum", lambda v: v / F.col("total")).alias("v"))


def joined_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, out): the parts' vectors as one array, by part."""
    return parts.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda r: r["v"])).alias("out"))


def softmax_sums(rows: DataFrame, key: str, heads: int, width: int) -> DataFrame:
    """(key, out): ``softmax_parts`` of all heads in one array.  ``rows``: (key, weight,
    proj, e) with the score ``e[h]`` and the vector ``proj[h * width .. (h + 1) * width - 1]``
    of each head."""
    each = [F.struct(F.lit(h).alias("h"), F.col("e")[h].alias("e"), F.slice("proj", h * width + 1, width).alias("v")) for h in range(heads)]
    rows = rows.select(key, "weight", F.explode(F.array(*each)).alias("r")).select(key, "weight", "r.*")
    return joined_parts(softmax_parts(rows, [key], width), [key])


def elu(v):
    return F.when(v > 0, v).otherwise(F.exp(v) - 1)


def attend(nodes: DataFrame, edges: DataFrame, weights: dict[str, np.ndarray], self_loops: bool = True,
           negative_slope: float = 0.2, activation: str | None = "elu", features: str = "features") -> DataFrame:
    """Forward pass of one graph-attention layer (heads concatenated).

    Per node (Arrow batches): projection W_h x and the two attention terms.
    Per edge j -> i: e = LeakyReLU(a_src[j] + a_dst[i]) per head.  The softmax over
    i's incoming edges and the weighted sum of W_h x_j are one aggregate by dst
    (``softmax_sums``), so the projected vectors move with the edges once."""
    H, _, D = weights["W"].shape
    proj = nodes.select("node_id", _project_udf(weights)(F.col(features)).alias("p")).select("node_id", "p.*")
    proj = cut_lineage(proj)
    e = edges.select("src", "dst")
    if self_loops:
        e = e.where(F.col("src") != F.col("dst")).unionByName(nodes.select(F.col("node_id").alias("src"),
                                                                          F.col("node_id").alias("dst")))
    e = compact_edges(e)      # a repeated edge is one message counted ``weight`` times
    src_side = proj.select(F.col("node_id").alias("src"), "proj", "a_src")
    dst_side = proj.select(F.col("node_id").alias("dst"), "a_dst")
    # the narrow side first: vectors are joined last and go straight into the sums
    ee = e.join(dst_side, "dst").join(src_side, "src")
    score = F.zip_with("a_src", "a_dst", lambda s, t: F.when(s + t > 0, s + t).otherwise((s + t) * negative_slope))
    out = softmax_sums(ee.select(F.col("dst").alias("node_id"), "weight", "proj", score.alias("e")), "node_id", H, D)
    moved = F.zip_with("out", F.array(*[F.lit(float(b)) for b in weights["bias"]]), lambda v, b: v + b)
    return out.select("node_id", (F.transform(moved, elu) if activation == "elu" else moved).alias(features))


def convolve(nodes: DataFrame, edges: DataFrame, weight: np.ndarray, bias: np.ndarray | None = None, activation: str | None = "elu",
             features: str = "features") -> DataFrame:
    """Graph convolution layer: D^-1/2 (A + I) D^-1/2 X W + b, with repeated edges
    as weights of A, a self loop for each node (given ones count once) and D the
    weighted in-degrees with it.

    Edges are compacted once and written, as the degrees and the sums read them.
    A node's features over the root of its degree travel with its edges; the sums by dst
    are partial aggregates, before the projection (``weight``: inputs x outputs)."""
    d_in, d_out = weight.shape
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0).alias("weight"))
    e = cut_lineage(compact_edges(edges.where(F.col("src") != F.col("dst"))).unionByName(loops), "convolution-edges")
    root = e.groupBy(F.col("dst").alias("node_id")).agg(F.sqrt(F.sum("weight")).alias("__root"))
    x = cut_lineage(nodes.select("node_id", features).join(root, "node_id"), "convolution-nodes")
    sent = e.join(x.select(F.col("node_id").alias("src"), F.transform(features, lambda v: v / F.col("__root")).alias("x")), "src")
    sums = sent.groupBy(F.col("dst").alias("node_id")).agg(*[F.sum(F.col("weight") * F.col("x")[i]).alias(f"__s{i}") for i in range(d_in)])
    both = sums.join(x.select("node_id", "__root"), "node_id")
    b = np.zeros(d_out) if bias is None else bias
    out = []
    for j in range(d_out):
        v = sum((F.col(f"__s{i}") * float(weight[i, j]) for i in range(d_in)), F.lit(0.0)) / F.col("__root") + float(b[j])
        out.append(elu(v) if activation == "elu" else v)
    return both.select("node_id", F.array(*out).alias(features))


def batch_norm(nodes: DataFrame, features: str = "features", eps: float = 1e-5) -> DataFrame:
    """Per position: (x - mean) / sqrt(var + eps) with population statistics
    over all nodes (training-mode normalisation, unit scale, zero shift);
    one aggregate whose one-row result (two arrays) is applied by scalar subqueries."""
    d = _dim(nodes, features)
    stats = nodes.agg(F.array(*[F.avg(F.col(features)[i]) for i in range(d)]).alias("m"), F.array(*[F.var_pop(F.col(features)[i]) for i in range(d)]).alias("v"))
    m, v = stats.select("m").scalar(), stats.select("v").scalar()
    centred = F.zip_with(features, "__m", lambda x, y: x - y)
    scaled = F.zip_with(centred, "__v", lambda x, y: x / F.sqrt(y + F.lit(eps)))
    return nodes.withColumns({"__m": m, "__v": v}).withColumn(features, scaled).drop("__m", "__v")


def attention_stack(nodes: DataFrame, edges: DataFrame, layers: list[dict[str, np.ndarray]],
                    residual: bool = False, use_batch_norm: bool = False, features: str = "features") -> DataFrame:
    """Stacked attention layers: layer -> (batch norm) -> ELU.  With
    ``residual`` a layer after the first adds the kept representation, which
    is the stack's input until a sum replaces it, where the widths match.
    Every layer's output is written to the checkpoint folder (lineage cut
    per layer)."""
    cur = cut_lineage(nodes.select("node_id", features))
    kept = cur
    for i, w in enumerate(layers):
        out = attend(cur, edges, w, activation=None if use_batch_norm else "elu", features=features)
        if use_batch_norm:
            out = batch_norm(out, features)
            out = out.withColumn(features, F.transform(features, elu))
        w_out = w["W"].shape[0] * w["W"].shape[2]
        add = residual and i > 0 and w_out == _dim(kept, features)
        if add:
            out = (out.join(kept.withColumnRenamed(features, "__kept"), "node_id")
                   .select("node_id", F.zip_with(features, "__kept", lambda a, b: a + b).alias(features)))
        cur = cut_lineage(out.select("node_id", features))
        kept = cur if add else kept
    return cur


def attention_weights(nodes: DataFrame, edges: DataFrame, weights: dict[str, np.ndarray], self_loops: bool = True,
                      negative_slope: float = 0.2, features: str = "features") -> DataFrame:
    """Per edge (src, dst) the softmax attention per head (for inspection and tests)."""
    proj = nodes.select("node_id", _project_udf(weights)(F.col(features)).alias("p")).select("node_id", "p.*")
    e = edges.select("src", "dst")
    if self_loops:
        e = e.where(F.col("src") != F.col("dst")).unionByName(nodes.select(F.col("node_id").alias("src"),
                                                                          F.col("node_id").alias("dst")))
    ee = (e.join(proj.select(F.col("node_id").alias("src"), "a_src"), "src")
          .join(proj.select(F.col("node_id").alias("dst"), "a_dst"), "dst"))
    H = weights["W"].shape[0]
    score = F.zip_with("a_src", "a_dst", lambda s, t: F.when(s + t > 0, s + t).otherwise((s + t) * negative_slope))
    ee = ee.select("src", "dst", score.alias("e"))
    mx = ee.groupBy("dst").agg(*[F.max(F.col("e")[h]).alias(f"m{h}") for h in range(H)])
    x = ee.join(mx, "dst").select("src", "dst", *[F.exp(F.col("e")[h] - F.col(f"m{h}")).alias(f"x{h}") for h in range(H)])
    den = x.groupBy("dst").agg(*[F.sum(f"x{h}").alias(f"s{h}") for h in range(H)])
    return x.join(den, "dst").select("src", "dst", F.array(*[F.col(f"x{h}") / F.col(f"s{h}") for h in range(H)]).alias("alpha"))


# ------------------------------------------------- graph reconstruction ----
def fit_graph_head(nodes: DataFrame, neigh: DataFrame, ridge: float = 1e-3, features: str = "features") -> np.ndarray:
    """Linear head predicting a node's features from its neighbour mean,
    fitted by distributed normal equations: each task sums Z'Z and Z'X over its
    rows, the sums are added across tasks, and the driver solves one
    (d+1) x (d+1) system."""
    d = _dim(nodes, features)
    z = nodes.select("node_id", F.col(features).alias("x")).join(
        neigh.select("node_id", F.col(features).alias("h")), "node_id").select("x", "h")

    def partial(batches):
        both = np.zeros((d + 1, 2 * d + 1))
        for pdf in batches:
            if len(pdf):
                h = np.column_stack([np.stack(pdf["h"].to_numpy()), np.ones(len(pdf))])
                both += h.T @ np.column_stack([h, np.stack(pdf["x"].to_numpy())])
        return both.ravel()

    both = partition_sums(z, partial, (d + 1) * (2 * d + 1)).reshape(d + 1, 2 * d + 1)
    return np.linalg.solve(both[:, : d + 1] + ridge * np.eye(d + 1), both[:, d + 1:])


def graph_error(nodes: DataFrame, edges: DataFrame, ridge: float = 1e-3, features: str = "features") -> DataFrame:
    """Per node: MSE between its features and the linear prediction from its
    in-neighbour mean (column ``graph_error``)."""
    neigh = k_hop_mean(nodes, edges, 1, features)
    Wt = fit_graph_head(nodes, neigh, ridge, features)
    z = nodes.select("node_id", F.col(features).alias("x")).join(
        neigh.select("node_id", F.col(features).alias("h")), "node_id")

    @F.pandas_udf("double")
    def error(x: pd.Series, h: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype="float64")
        H = np.column_stack([np.stack(h.to_numpy()), np.ones(len(h))])
        return pd.Series(((np.stack(x.to_numpy()) - H @ Wt) ** 2).mean(axis=1))

    return z.select("node_id", error("x", "h").alias("graph_error"))


def combined_score(ae: DataFrame, graph: DataFrame, w: float = 0.5, id_col: str = "log_id",
                   ae_col: str = "reconstruction_error", graph_col: str = "graph_score") -> DataFrame:
    """w * autoencoder error + (1 - w) * graph score, per request.  A request
    of no node (e.g. no IP) keeps its row; its graph score is NULL and adds 0."""
    return (ae.select(id_col, ae_col).join(graph.select(id_col, graph_col), id_col, "left")
            .withColumn("combined_score", F.lit(w) * F.col(ae_col) + F.lit(1.0 - w) * F.coalesce(F.col(graph_col), F.lit(0.0))))
