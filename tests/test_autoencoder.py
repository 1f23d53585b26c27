"""Autoencoder: gradient check, partition independence, artefact round trip."""

import numpy as np
from pyspark.sql import functions as F

from loghawk.operators import autoencoder as AE
from loghawk.operators import detect as DT
from loghawk.operators import mlp
from loghawk.sources.artefact import load_model, save_model


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(9, 4))
    ids = np.arange(9)
    p = mlp.init_params(4, (5, 3), 1)
    th = mlp.flatten(p)
    for final in ("relu", "linear"):
        _, g = mlp.loss_and_grad(X, p, final, 0.25, ids, 3, 2)
        for i in range(0, th.size, 5):
            t = th.copy(); t[i] += 1e-6
            lp, _ = mlp.loss_and_grad(X, mlp.unflatten(t, 4, (5, 3)), final, 0.25, ids, 3, 2)
            t[i] -= 2e-6
            lm, _ = mlp.loss_and_grad(X, mlp.unflatten(t, 4, (5, 3)), final, 0.25, ids, 3, 2)
            assert abs((lp - lm) / 2e-6 - g[i]) < 1e-6


def _data(spark, n=600, d=5):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(n, d))
    rows = [(i, [float(v) for v in X[i]], "train" if i % 5 else "test") for i in range(n)]
    return spark.createDataFrame(rows, "log_id long, features array<double>, split string")


def test_same_fit_for_any_partitioning(spark):
    df = _data(spark)
    m1 = AE.fit_autoencoder(df.coalesce(1), hidden=(8, 4), epochs=4, dropout=0.2, seed=5)
    m8 = AE.fit_autoencoder(df.repartition(8), hidden=(8, 4), epochs=4, dropout=0.2, seed=5)
    assert np.allclose(m1.weights, m8.weights, atol=1e-9)
    assert m1.history[-1][2] is not None and len(m1.history) == 4


def test_training_reduces_loss(spark):
    m = AE.fit_autoencoder(_data(spark), hidden=(16, 8), epochs=30, lr=1e-2, dropout=0.0, seed=1, final="linear")
    assert m.history[-1][1] < m.history[0][1]


def test_save_load_same_scores(spark, tmp_path):
    df = _data(spark, 200)
    m = AE.fit_autoencoder(df, hidden=(6, 3), epochs=2, seed=2)
    m.threshold = 0.5
    save_model(spark, m, str(tmp_path / "m"), {"names": ["a"]})
    m2, spec = load_model(spark, str(tmp_path / "m"))
    e1 = DT.reconstruction_error(AE.reconstruct(df, m)).orderBy("log_id").select("reconstruction_error").toPandas()
    e2 = DT.reconstruction_error(AE.reconstruct(df, m2)).orderBy("log_id").select("reconstruction_error").toPandas()
    assert np.allclose(e1.values, e2.values) and m2.threshold == 0.5 and spec == {"names": ["a"]}
    lat = AE.encode(df, m2).select(F.size("latent")).first()[0]
    assert lat == 3


def test_elu_head_gradient_and_training(spark):
    from loghawk.operators.classify import accuracy, fit_elu_head, predict_elu_head
    rng = np.random.default_rng(3)
    X = rng.normal(size=(8, 5))
    y = rng.integers(0, 3, 8)
    p = mlp.init_head(5, 4, 3, 1)
    th = mlp.flatten(p)
    sizes = mlp.head_sizes(5, 4, 3)
    _, _, g = mlp.head_loss_and_grad(X, y, p, 0.3, np.arange(8), 2, 1)
    for i in range(0, th.size, 3):
        t = th.copy(); t[i] += 1e-6
        lp = mlp.head_loss_and_grad(X, y, mlp.unflatten_sizes(t, sizes), 0.3, np.arange(8), 2, 1)[0]
        t[i] -= 2e-6
        lm = mlp.head_loss_and_grad(X, y, mlp.unflatten_sizes(t, sizes), 0.3, np.arange(8), 2, 1)[0]
        assert abs((lp - lm) / 2e-6 - g[i]) < 1e-5
    # separable toy data: the head learns it
    pts = rng.normal(size=(300, 2))
    lab = (pts[:, 0] > 0).astype(int) + (pts[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, [float(a), float(b)], int(c)) for i, ((a, b), c) in enumerate(zip(pts, lab))],
                               "log_id long, features array<double>, label int")
    m = fit_elu_head(df, hidden=16, lr=0.05, epochs=60, dropout=0.0)
    assert m["history"][-1][1] < m["history"][0][1]
    acc = accuracy(predict_elu_head(df, m), "label", "prediction").first()[0]
    assert acc > 0.8


def test_resume_from_saved_state(spark, tmp_path):
    df = _data(spark, 300)
    full = AE.fit_autoencoder(df, hidden=(6, 3), epochs=6, seed=9)
    state = str(tmp_path / "state")
    AE.fit_autoencoder(df, hidden=(6, 3), epochs=4, seed=9, state_path=state, save_every=2)   # "crashes" after 4
    resumed = AE.fit_autoencoder(df, hidden=(6, 3), epochs=6, seed=9, state_path=state, save_every=2)
    assert np.allclose(full.weights, resumed.weights, atol=1e-9)
    assert [h[0] for h in resumed.history] == list(range(6))


def test_early_stop_keeps_the_best_weights(spark):
    from loghawk.operators.classify import accuracy, fit_elu_head, predict_elu_head, search_head
    df = _data(spark, 300)
    m = AE.fit_autoencoder(df, hidden=(6, 3), epochs=40, lr=0.5, dropout=0.0, seed=3, patience=2)
    assert len(m.history) < 40
    test = df.where("split = 'test'")
    got = AE.with_error(test, m).agg(F.avg("reconstruction_error")).first()[0]
    assert abs(got - min(h[2] for h in m.history)) < 1e-9
    rng = np.random.default_rng(5)
    rows = [(i, [float(a), float(b)], int(a + b > 0)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    d = spark.createDataFrame(rows, "log_id long, features array<double>, label int")
    train, valid = d.where("log_id < 150"), d.where("log_id >= 150")
    head = fit_elu_head(train, hidden=8, lr=0.1, epochs=30, dropout=0.0, valid=valid, patience=3)
    best = max(v for _, v in head["validation"])
    assert len(head["history"]) <= 30 and accuracy(predict_elu_head(valid, head), "label", "prediction").first()[0] == best
    table, model = search_head(train, valid, n_trials=2, epochs=3)
    assert table.count() == 2 and max(v for _, v in model["validation"]) == table.agg(F.max("val_accuracy")).first()[0]


def test_queries_train_the_whole_50_epochs(spark, monkeypatch):
    """Every query that trains the detector asks for the reference's 50 epochs."""
    import pytest

    import __spark_entry__ as E
    from conftest import SF001

    class Asked(Exception):
        pass

    def fit(df, *args, epochs=50, **named):
        raise Asked(epochs)

    monkeypatch.setattr(AE, "fit_autoencoder", fit)
    for name in ("ae_training_history", "ae_detect_top_anomalies", "ae_detect_summary", "ae_encode", "stream_scoring"):
        with pytest.raises(Asked) as asked:
            E.queries()[name](spark, SF001)
        assert asked.value.args == (50,), name
