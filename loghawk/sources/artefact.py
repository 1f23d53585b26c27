"""Model artefact: one row (weights, shapes, feature contract, scaler,
threshold) written as Parquet; reading falls back to the reference's
default hyper-parameters when fields are absent."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from loghawk.operators.autoencoder import AutoencoderModel

# Defaults used when stored parameters are missing.
DEFAULT_HIDDEN = (128, 64, 32)
DEFAULT_DROPOUT = 0.2

_SCHEMA = ("input_dim int, hidden array<int>, dropout double, final string, weights array<double>, "
           "feature_names array<string>, scaler_json string, threshold double, spec_json string")


def save_model(spark: SparkSession, model: AutoencoderModel, path: str, spec: dict | None = None) -> None:
    row = (model.input_dim, list(model.hidden), float(model.dropout), model.final, model.weights.tolist(),
           list(model.feature_names), json.dumps(model.scaler), model.threshold, json.dumps(spec or {}))
    spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[AutoencoderModel, dict]:
    r = spark.read.parquet(path).first().asDict()
    hidden = tuple(r.get("hidden") or DEFAULT_HIDDEN)
    dropout = r.get("dropout")
    model = AutoencoderModel(int(r["input_dim"]), hidden, DEFAULT_DROPOUT if dropout is None else dropout,
                             r.get("final") or "relu", np.array(r["weights"], dtype=np.float64),
                             list(r.get("feature_names") or []),
                             {k: tuple(v) for k, v in json.loads(r.get("scaler_json") or "{}").items()},
                             r.get("threshold"))
    return model, json.loads(r.get("spec_json") or "{}")
