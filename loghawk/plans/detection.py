"""Train-then-detect plan around the autoencoder.

Training: raw log -> features (batch path) -> z-score (scaler kept) ->
vector -> hash split -> full-batch training -> threshold (mean + 3 std of
the held-out errors).  Detection on new data reuses the stored feature
names, one-hot vocabulary and scaler: a named contract, never "the first n
columns", and no re-fitting on the data being judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.operators import autoencoder as AE
from loghawk.operators import detect as DT
from loghawk.operators.scaling import Scaler, apply_scaler, fit_scaler, split, to_vector
from loghawk.operators.schema import detect_roles
from loghawk.operators.sparse import fit_sparse_autoencoder, indexed_vocabulary, one_hot_indices, with_sparse_error
from loghawk.plans.preprocess import FeatureSpec, derive_features
from loghawk.session import cut_lineage


def prepare(log: DataFrame, spec: FeatureSpec | None = None, scaler: Scaler | None = None, id_col: str = "log_id",
            carry: str | None = None, stored_counts=None, mode: str = "batch") -> tuple[DataFrame, FeatureSpec, Scaler]:
    """Scaled feature vectors (``mode``: see ``derive_features``; a ``spec`` has its own).  With a ``spec``, a feature that the log cannot
    give is an error; the one-hots of endpoints that don't occur are zeros.
    ``scale_onehot=False`` in the spec leaves the one-hots as they are."""
    feats, new_spec = derive_features(log, mode=spec.mode if spec else mode, endpoint_vocab=spec.endpoint_vocab if spec else None, id_col=id_col,
                                      names=spec.names if spec else None, carry=carry, stored_counts=stored_counts)
    spec = spec or new_spec
    missing = [n for n in spec.names if n not in feats.columns]
    if missing:
        raise ValueError(f"the log gives no {missing}")
    scaler = scaler or fit_scaler(feats, [n for n in spec.names if spec.scale_onehot or n not in spec.onehot_names()]).collect()
    z = apply_scaler(feats, scaler)
    return to_vector(z, spec.names, "features", keep=(id_col, carry) if carry else (id_col,)), spec, scaler


def train_detector(log: DataFrame, epochs: int = 50, hidden=(128, 64, 32), lr: float = 1e-3, dropout: float = 0.2,
                   seed: int = 42, train_fraction: float = 0.8, final: str = "relu", state_path: str | None = None,
                   patience: int | None = None, batches: int = 1, mode: str = "batch"):
    """Fit the detector; features, vocabulary, scaler and network come from the
    whole log (``mode='window'``: for ``streaming.streams.score_with_window_counts``).  ``patience`` stops early, ``batches`` are the steps of an epoch."""
    # the features are derived once, not again for the scaler and each pass that training makes
    feats, spec = derive_features(log, mode=mode)
    feats = cut_lineage(split(feats, train_fraction, seed, out="__split"), "training-rows")
    scaler = fit_scaler(feats, [n for n in spec.names if spec.scale_onehot or n not in spec.onehot_names()]).collect()
    tagged = to_vector(apply_scaler(feats, scaler), spec.names, keep=("log_id", "__split")).withColumnRenamed("__split", "split")
    model = AE.fit_autoencoder(tagged, hidden=hidden, lr=lr, epochs=epochs, dropout=dropout, seed=seed, final=final,
                               feature_names=spec.names, state_path=state_path, patience=patience, batches=batches)
    model.scaler = dict(scaler.params)
    test = tagged.where(F.col("split") == "test")
    errs = AE.with_error(test, model)
    model.threshold = float(DT.threshold(errs, method="std").first()[0])
    return model, spec


def score_log(log: DataFrame, model: AE.AutoencoderModel, spec: FeatureSpec, id_col: str = "log_id", stored_counts=None) -> DataFrame:
    """Scored log: the original columns + reconstruction_error, is_anomaly,
    anomaly_score.  The log's row is carried through the features, so the log
    is scanned once besides the count aggregates and joined with no copy of
    itself; rows with a NULL id are scored like any other."""
    scaler = Scaler(list(model.scaler), params=dict(model.scaler))
    vec, _, _ = prepare(log, spec, scaler, id_col, carry="__row", stored_counts=stored_counts)
    scored = AE.with_error(vec, model).select("__row.*", "reconstruction_error")
    return DT.flag_and_score(scored, model.threshold)


# ------------------------------------------------ sparse one-hots ----
def prepare_sparse(log: DataFrame, spec: FeatureSpec | None = None, scaler: Scaler | None = None,
                   vocabularies: dict[str, DataFrame] | None = None, id_col: str = "log_id", carry: str | None = None,
                   stored_counts=None) -> tuple[DataFrame, FeatureSpec, Scaler, dict[str, DataFrame], int]:
    """``prepare`` with the endpoint one-hots as ``indices`` and ``values``: scaled
    dense ``features``, the feature contract, the scaler, the vocabularies (stored
    tables) and their size.  The one-hots stay 0/1, as ``scale_onehot=False``."""
    vocabularies = _vocabularies(log) if vocabularies is None else vocabularies
    feats, new_spec, positions = _sparse_features(log, vocabularies, spec, id_col, stored_counts)
    spec = spec or new_spec
    missing = [n for n in spec.names if n not in feats.columns]
    if missing:
        raise ValueError(f"the log gives no {missing}")
    scaler = scaler or fit_scaler(feats, spec.names).collect()
    row = [F.struct(*[F.col("__row")[c].alias(c) for c in log.columns]).alias(carry)] if carry else []
    return _sparse_vectors(feats, spec, scaler, id_col).select(id_col, "features", "indices", "values", *row), spec, scaler, vocabularies, positions


def _vocabularies(log: DataFrame) -> dict[str, DataFrame]:
    roles = detect_roles(log.schema, "typed")
    return {c: cut_lineage(indexed_vocabulary(log, c), f"vocabulary-{c}") for c in roles["endpoint"] if dict(log.dtypes)[c] == "string"}


def _sparse_features(log: DataFrame, vocabularies: dict[str, DataFrame], spec: FeatureSpec | None = None, id_col: str = "log_id", stored_counts=None):
    """(unscaled features with the log's row and its one-hots in ``__row``, feature contract, positions)."""
    hot, positions = one_hot_indices(log, vocabularies, "__indices", "__values")
    feats, new_spec = derive_features(hot, mode="batch", id_col=id_col, names=spec.names if spec else None, carry="__row",
                                      stored_counts=stored_counts, dense_onehot=False)
    return feats, new_spec, positions


def _sparse_vectors(feats: DataFrame, spec: FeatureSpec, scaler: Scaler, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    vec = to_vector(apply_scaler(feats, scaler), spec.names, "features", keep=(id_col, "__row", *keep))
    return vec.withColumns({"indices": F.col("__row.__indices"), "values": F.col("__row.__values")})


def train_sparse_detector(log: DataFrame, epochs: int = 50, hidden=(128, 64, 32), lr: float = 1e-3, dropout: float = 0.2, seed: int = 42,
                          train_fraction: float = 0.8, final: str = "relu", state_path: str | None = None, patience: int | None = None,
                          batches: int = 1):
    """``train_detector`` for endpoints of any number: (model, spec, vocabularies)."""
    vocabularies = _vocabularies(log)
    feats, spec, positions = _sparse_features(log, vocabularies)
    row = F.struct("__row.__indices", "__row.__values").alias("__row")
    # the features are derived once, as in ``train_detector``
    feats = cut_lineage(split(feats.withColumn("__row", row), train_fraction, seed, out="__split"), "training-rows")
    scaler = fit_scaler(feats, spec.names).collect()
    tagged = _sparse_vectors(feats, spec, scaler, "log_id", ("__split",)).select("log_id", "features", "indices", "values", F.col("__split").alias("split"))
    model = fit_sparse_autoencoder(tagged, positions, hidden=hidden, lr=lr, epochs=epochs, dropout=dropout, seed=seed, final=final,
                                   feature_names=spec.names, state_path=state_path, patience=patience, batches=batches)
    model.scaler = dict(scaler.params)
    errs = with_sparse_error(tagged.where(F.col("split") == "test"), model)
    model.threshold = float(DT.threshold(errs, method="std").first()[0])
    return model, spec, vocabularies


def score_log_sparse(log: DataFrame, model: AE.AutoencoderModel, spec: FeatureSpec, vocabularies: dict[str, DataFrame],
                     id_col: str = "log_id", stored_counts=None) -> DataFrame:
    """``score_log`` with the stored vocabularies; endpoints outside them are zeros."""
    scaler = Scaler(list(model.scaler), params=dict(model.scaler))
    vec = prepare_sparse(log, spec, scaler, vocabularies, id_col, carry="__log", stored_counts=stored_counts)[0]
    scored = with_sparse_error(vec, model).select("__log.*", "reconstruction_error")
    return DT.flag_and_score(scored, model.threshold)
