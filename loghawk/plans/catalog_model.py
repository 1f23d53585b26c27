"""Registered autoencoder queries and the model artefact (IO5)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loghawk.operators import autoencoder as AE
from loghawk.operators import detect as DT
from loghawk.operators.scaling import split, split_cut
from loghawk.operators.sparse import fit_sparse_autoencoder, with_sparse_error
from loghawk.plans import sql_nets
from loghawk.plans.detection import prepare, prepare_sparse, score_log, score_log_sparse, train_detector, train_sparse_detector
from loghawk.plans.preprocess import FeatureSpec
from loghawk.plans.registry import finish, register, sql_finish, with_log
from loghawk.session import scratch_path
from loghawk.sources.artefact import load_model, save_model
from loghawk.sources.tables import api_log, read_table


def _trained(spark, sf):
    return train_detector(api_log(spark, sf), epochs=50)


@register("ae_training_history")
def q_history(spark, sf):
    """Train / held-out loss per epoch of the full-batch autoencoder (50 epochs)."""
    model, _ = _trained(spark, sf)
    return AE.history(model, spark)


@register("ae_detect_top_anomalies")
def q_detect(spark, sf):
    """Save, reload, score the whole log with the stored contract, top 10."""
    model, spec = _trained(spark, sf)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    save_model(spark, model, path, spec.to_dict())
    loaded, spec_d = load_model(spark, path)
    scored = score_log(api_log(spark, sf), loaded, FeatureSpec.from_dict(spec_d))
    return DT.top_anomalies(scored, 10).select("log_id", "ip_address", "endpoint", "status_code",
                                                "reconstruction_error", "is_anomaly", "anomaly_score")


@register("ae_detect_summary")
def q_detect_summary(spark, sf):
    model, spec = _trained(spark, sf)
    return DT.summary(score_log(api_log(spark, sf), model, spec))


@register("ae_encode")
def q_encode(spark, sf):
    model, spec = _trained(spark, sf)
    vec, _, _ = prepare(api_log(spark, sf), spec, _scaler(model))
    return AE.encode(vec, model).select("log_id", "latent")


def _scaler(model):
    from loghawk.operators.scaling import Scaler
    return Scaler(list(model.scaler), params=dict(model.scaler))


# A network with given weights, 2 -> 2 -> 2, ReLU after both layers: W row by row, then b, of each layer.
_FIXED = (0.5, -0.25, 0.3, 0.8, 0.1, -0.05, 0.6, 0.2, -0.4, 0.9, 0.05, 0.15)
_FIXED_SCALER = {"status_code": (250.0, 100.0), "response_ms": (50.0, 30.0)}
_FIXED_THRESHOLD = 0.5


def fixed_detector():
    """The network with given weights and its feature contract."""
    import numpy as np
    model = AE.AutoencoderModel(2, (2,), 0.0, "relu", np.array(_FIXED), list(_FIXED_SCALER), scaler=dict(_FIXED_SCALER), threshold=_FIXED_THRESHOLD)
    return model, FeatureSpec(list(_FIXED_SCALER), {}, {"endpoint": []})


_WINDOW_SCALER = {"requests_per_ip_5min": (1.0, 0.5), "response_ms": (50.0, 30.0)}


def fixed_window_detector():
    """The same network over the count of an IP's requests in five minutes and the response time."""
    import numpy as np
    model = AE.AutoencoderModel(2, (2,), 0.0, "relu", np.array(_FIXED), list(_WINDOW_SCALER), scaler=dict(_WINDOW_SCALER), threshold=_FIXED_THRESHOLD)
    return model, FeatureSpec(list(_WINDOW_SCALER), {}, {"endpoint": []}, mode="window")


def fixed_window_sql(columns: str) -> str:
    counted = ("SELECT *, CASE WHEN ip_address IS NOT NULL THEN count(*) OVER (PARTITION BY ip_address, time_bucket(INTERVAL '5 minutes', request_time)) END"
               " AS requests_per_ip_5min FROM api_log")
    return fixed_sql(columns, _WINDOW_SCALER, f", counted AS ({counted})", "counted")


def fixed_sql(columns: str, scaler: dict = _FIXED_SCALER, ctes: str = "", source: str = "api_log") -> str:
    w = [f"({x!r})" for x in _FIXED]
    scaled = ", ".join(f"(COALESCE(CAST({c} AS DOUBLE), 0) - {m!r}) / {s!r} AS x{i}" for i, (c, (m, s)) in enumerate(scaler.items()))
    layer = lambda k, a, b: [f"greatest(0.0, {w[k]} * {a} + {w[k + 1]} * {b} + {w[k + 4]})", f"greatest(0.0, {w[k + 2]} * {a} + {w[k + 3]} * {b} + {w[k + 5]})"]
    h, y = layer(0, "x0", "x1"), layer(6, "h0", "h1")
    return with_log(f"{ctes}, x AS (SELECT log_id, ip_address, {scaled} FROM {source}), h AS (SELECT *, {h[0]} AS h0, {h[1]} AS h1 FROM x)"
                    f", y AS (SELECT *, ((x0 - {y[0]}) ^ 2 + (x1 - {y[1]}) ^ 2) / 2 AS reconstruction_error FROM h)"
                    f", r AS (SELECT *, reconstruction_error > {_FIXED_THRESHOLD!r} AS is_anomaly, reconstruction_error / {_FIXED_THRESHOLD!r} AS anomaly_score FROM y)"
                    f" SELECT {columns} FROM r")


@register("ae_fixed_weights_scored", sql_finish(fixed_sql("log_id, reconstruction_error, is_anomaly, anomaly_score"),
                                                doubles=["reconstruction_error", "anomaly_score"], others=["log_id", "is_anomaly"]))
def q_fixed_scored(spark, sf):
    """A network with given weights saved, loaded and applied to the log (IO5, AE2, DT1, DT2)."""
    model, spec = fixed_detector()
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    save_model(spark, model, path, spec.to_dict())
    loaded, spec_d = load_model(spark, path)
    return finish(score_log(api_log(spark, sf), loaded, FeatureSpec.from_dict(spec_d)).select("log_id", "reconstruction_error", "is_anomaly", "anomaly_score"))


@register("ae_fixed_weights_encoded", sql_finish(fixed_sql("log_id, h0, h1"), doubles=["h0", "h1"], others=["log_id"]))
def q_fixed_encoded(spark, sf):
    model, spec = fixed_detector()
    vec, _, _ = prepare(api_log(spark, sf), spec, _scaler(model))
    out = AE.encode(vec, model)
    return finish(out.select("log_id", F.col("latent")[0].alias("h0"), F.col("latent")[1].alias("h1")))


# ---- training from given weights ----
_STEPS, _RATE = 3, 0.05


def _split_sql(seed: int = 42, fraction: float = 0.8) -> str:
    return f"substring(md5(concat('{seed}|', CAST(log_id AS VARCHAR))), 1, 8) < '{split_cut(fraction)}' AS train"


def _x_sql(endpoints: int = 0) -> str:
    dense = ", ".join(f"(COALESCE(CAST({c} AS DOUBLE), 0) - {m!r}) / {s!r} AS x{i}" for i, (c, (m, s)) in enumerate(_FIXED_SCALER.items()))
    hot = "".join(f", CASE WHEN endpoint = v[{i + 1}] THEN 1.0 ELSE 0.0 END AS x{2 + i}" for i in range(endpoints))
    return with_log(f", voc AS (SELECT list(DISTINCT endpoint ORDER BY endpoint) AS v FROM api_log), x AS (SELECT log_id, {dense}{hot}, {_split_sql()} FROM api_log, voc)")


_DENSE_CTES, _DENSE_N = sql_nets.autoencoder_ctes(2, 2, list(_FIXED), _STEPS, _RATE)


def _fixed_fit(spark, sf):
    model, spec = fixed_detector()
    vec, _, _ = prepare(api_log(spark, sf), spec, _scaler(model))
    return AE.fit_autoencoder(split(vec, 0.8, 42), hidden=(2,), lr=_RATE, epochs=_STEPS, dropout=0.0, init=list(_FIXED))


@register("ae_fit_given_weights", sql_finish(sql_nets.trained_weights(_x_sql() + _DENSE_CTES, _DENSE_N, _STEPS), doubles=["weight"], others=["position"]))
def q_fit_given(spark, sf):
    """Three epochs of full-batch Adam from given weights (AE1): the weights."""
    return finish(spark.createDataFrame([(k, float(w)) for k, w in enumerate(_fixed_fit(spark, sf).weights)], "position long, weight double"))


@register("ae_history_given_weights", sql_finish(sql_nets.loss_history(_x_sql() + _DENSE_CTES, _STEPS), doubles=["train_loss", "test_loss"], others=["epoch"]))
def q_history_given(spark, sf):
    """The losses of these epochs (AE6)."""
    return finish(AE.history(_fixed_fit(spark, sf), spark))


#: The log's endpoints, by which the given weights of the sparse network are counted.
_ENDPOINTS = 5
_SPARSE_CTES, _SPARSE_N = sql_nets.autoencoder_ctes(2 + _ENDPOINTS, 2, sql_nets.given_weights(4 * (2 + _ENDPOINTS) + 4 + _ENDPOINTS), 2, _RATE)


def _sparse_fit(spark, sf):
    """Two epochs on the two scaled features and the endpoints in sparse form."""
    model, spec = fixed_detector()
    vec, _, _, _, positions = prepare_sparse(api_log(spark, sf), spec, _scaler(model))
    width = 2 + positions
    init = sql_nets.given_weights(4 * width + 2 + width)
    fitted = fit_sparse_autoencoder(split(vec, 0.8, 42), positions, hidden=(2,), lr=_RATE, epochs=2, dropout=0.0, init=init, feature_names=spec.names, block=3)
    return vec, fitted


@register("ae_sparse_fit_given_weights", sql_finish(sql_nets.trained_weights(_x_sql(_ENDPOINTS) + _SPARSE_CTES, _SPARSE_N, 2), doubles=["weight"], others=["position"]))
def q_sparse_fit_given(spark, sf):
    """Sparse one-hots of the endpoint, trained from given weights: the weights of the dense form."""
    _, fitted = _sparse_fit(spark, sf)
    return finish(spark.createDataFrame([(k, float(w)) for k, w in enumerate(fitted.weights)], "position long, weight double"))


@register("ae_sparse_scored", sql_finish(_x_sql(_ENDPOINTS) + _SPARSE_CTES + " SELECT log_id, loss AS reconstruction_error FROM f2_", doubles=["reconstruction_error"], others=["log_id"]))
def q_sparse_scored(spark, sf):
    """That network's error of each request."""
    vec, fitted = _sparse_fit(spark, sf)
    return finish(with_sparse_error(vec, fitted).select("log_id", "reconstruction_error"))


@register("ae_sparse_detect_summary")
def q_sparse_detect(spark, sf):
    """The detector with sparse one-hots: 50 epochs or an early stop; then the log is scored."""
    log = api_log(spark, sf)
    model, spec, vocabularies = train_sparse_detector(log, epochs=50, patience=5)
    return DT.summary(score_log_sparse(log, model, spec, vocabularies))


_EMB = 64


def _centroid_sql(select: str) -> str:
    cent = ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS c{i}" for i in range(_EMB))
    err = " + ".join(f"(CAST(e.embedding[{i + 1}] AS DOUBLE) - c.c{i}) ^ 2" for i in range(_EMB))
    return (f"WITH c AS (SELECT label, {cent} FROM embeddings GROUP BY label),"
            f" r AS (SELECT e.vec_id, ({err}) / {float(_EMB)} AS reconstruction_error FROM embeddings e"
            f" JOIN c ON e.label = c.label) {select}")


def _centroid_errors(spark, sf):
    """Reconstruction = the embedding's class centroid (mean vector per label)."""
    emb = read_table(spark, sf, "embeddings").select("vec_id", "label",
                                                     F.col("embedding").cast("array<double>").alias("features"))
    cent = emb.groupBy("label").agg(*[F.avg(F.col("features")[i]).alias(f"c{i}") for i in range(_EMB)])
    cent = cent.select("label", F.array(*[F.col(f"c{i}") for i in range(_EMB)]).alias("reconstruction"))
    return DT.reconstruction_error(emb.join(cent, "label"))


@register("ae_reconstruction_error", sql_finish(_centroid_sql("SELECT * FROM r"), doubles=["reconstruction_error"],
                                                others=["vec_id"]))
def q_rec_err(spark, sf):
    return finish(_centroid_errors(spark, sf).select("vec_id", "reconstruction_error"))


@register("ae_mean_loss", sql_finish(_centroid_sql("SELECT avg(reconstruction_error) AS mean_loss FROM r"),
                                     doubles=["mean_loss"]))
def q_mean_loss(spark, sf):
    return finish(DT.mean_loss(_centroid_errors(spark, sf)))
