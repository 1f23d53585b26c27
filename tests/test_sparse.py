"""Sparse one-hots: the vocabulary table and the autoencoder over indices and values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loghawk.operators import autoencoder as AE
from loghawk.operators import mlp
from loghawk.operators import sparse as SP
from loghawk.plans import detection as D
from loghawk.plans.vector_sum import slot_sums
from loghawk.sources.tables import api_log

from conftest import SF001

HIDDEN = (6, 3)


@pytest.fixture(scope="module")
def both(spark):
    """The same 300 rows dense and sparse: 3 features and 41 positions, with rows without any."""
    rng = np.random.default_rng(7)
    dense = rng.normal(size=(300, 3))
    hot = [sorted(rng.choice(41, size=rng.integers(0, 4), replace=False).tolist()) for _ in range(300)]
    full = np.zeros((300, 44))
    full[:, :3] = dense
    for i, h in enumerate(hot):
        full[i, [3 + x for x in h]] = 1.0
    tag = ["test" if i % 5 == 0 else "train" for i in range(300)]
    a = spark.createDataFrame([(i, full[i].tolist(), tag[i]) for i in range(300)], "log_id long, features array<double>, split string")
    b = spark.createDataFrame([(i, dense[i].tolist(), hot[i], [1.0] * len(hot[i]), tag[i]) for i in range(300)],
                              "log_id long, features array<double>, indices array<int>, values array<double>, split string")
    return a, b


@pytest.mark.parametrize("final,dropout,batches", [("relu", 0.0, 1), ("relu", 0.3, 1), ("linear", 0.2, 3)])
def test_same_fit_as_the_dense_form(both, final, dropout, batches):
    a, b = both
    how = dict(hidden=HIDDEN, epochs=3, lr=0.01, dropout=dropout, seed=4, final=final, batches=batches)
    dense = AE.fit_autoencoder(a, **how)
    sparse = SP.fit_sparse_autoencoder(b, 41, feature_names=["a", "b", "c"], block=10, **how)
    assert sparse.input_dim == 44
    assert np.abs(dense.weights - sparse.weights).max() < 1e-9
    assert np.abs(np.array(dense.history) - np.array(sparse.history)).max() < 1e-9
    want = {r.log_id: r.reconstruction_error for r in AE.with_error(a, dense).collect()}
    got = {r.log_id: r.reconstruction_error for r in SP.with_sparse_error(b, sparse).collect()}
    assert max(abs(want[i] - got[i]) for i in want) < 1e-9


def test_only_positions_that_occur_are_moved(both, monkeypatch):
    _, b = both
    seen = []

    def counted(df, fn, width, keep=slot_sums):
        out = keep(df, fn, width)
        seen.append(out[0])
        return out

    monkeypatch.setattr(SP, "slot_sums", counted)
    SP.fit_sparse_autoencoder(b.where("log_id < 20"), 41, hidden=HIDDEN, epochs=1, dropout=0.0)
    occur = {3 + i for r in b.where("log_id < 20 and split = 'train'").collect() for i in r.indices} | {0, 1, 2}
    assert {int(s) for s in seen[0] if s < 44} == occur and len(occur) < 44


def test_mini_batches_deal_every_row_once():
    ids = np.arange(10_000)
    parts = [AE.in_batch(ids, b, 4, 9, 2) for b in range(4)]
    assert (np.sum(parts, axis=0) == 1).all()
    assert min(p.sum() for p in parts) > 2200
    assert (AE.in_batch(ids, 0, 4, 9, 3) != parts[0]).any()


def test_a_hundred_thousand_endpoints(spark):
    """The vocabulary is a table, and nothing of it is collected but its size."""
    n = 100_000
    log = spark.range(n).select(F.col("id").alias("log_id"), F.format_string("/api/item/%06d", F.col("id") * 7919 % n).alias("endpoint"))
    vocabulary = SP.indexed_vocabulary(log, "endpoint")
    rows, positions = SP.one_hot_indices(log, {"endpoint": vocabulary})
    assert positions == n
    assert rows.where(F.col("indices")[0] != F.col("log_id") * 7919 % n).count() == 0
    some = rows.where("log_id < 400").select("log_id", F.array(F.col("log_id") / 400.0).alias("features"), "indices", "values",
                                             F.when(F.col("log_id") % 5 == 0, "test").otherwise("train").alias("split"))
    model = SP.fit_sparse_autoencoder(some, positions, hidden=(4, 2), epochs=2, lr=0.01, dropout=0.0, feature_names=["x"])
    assert model.input_dim == n + 1 and model.history[1][1] < model.history[0][1]


def test_sparse_rows_of_nulls_and_unseen_values(spark):
    log = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "new")], "log_id long, endpoint string")
    seen = SP.indexed_vocabulary(log.where("log_id < 4"), "endpoint")
    out, n = SP.one_hot_indices(log, {"endpoint": seen})
    assert n == 2 and {r.log_id: (r.indices, list(r["values"])) for r in out.collect()} == {1: ([1], [1.0]), 2: ([], []), 3: ([0], [1.0]), 4: ([], [])}
    empty, n = SP.one_hot_indices(log.limit(0), {"endpoint": SP.indexed_vocabulary(log.limit(0), "endpoint")})
    assert n == 0 and empty.count() == 0


def test_sparse_detector_scores_the_log(spark):
    log = api_log(spark, SF001)
    model, spec, vocabularies = D.train_sparse_detector(log, epochs=2, hidden=(8, 4), patience=5)
    dense, _, _ = D.prepare(log)
    assert model.input_dim == len(dense.first()["features"])
    scored = D.score_log_sparse(log, model, spec, vocabularies)
    assert scored.columns[: len(log.columns)] == log.columns and scored.count() == log.count()
    new = log.withColumn("endpoint", F.lit("/never/seen"))
    assert D.score_log_sparse(new, model, spec, vocabularies).where("reconstruction_error is null").count() == 0


def test_gradient_slots_round_trip():
    rng = np.random.default_rng(3)
    g = SP.Gradient(9, 2, (4, 3))
    g.first[:], g.last[:] = rng.normal(size=g.first.shape), rng.normal(size=g.last.shape)
    g.seen[:] = True
    for m in [*g.middle.values(), *g.biases]:
        m[:] = rng.normal(size=m.shape)
    flat, tail = SP.Gradient(9, 2, (4, 3)).load(*g.slots([1.0, 2.0, 3.0, 4.0]), 4)
    want = mlp.flatten([(g.first.T, g.biases[0]), *[(g.middle[li], g.biases[li]) for li in sorted(g.middle)], (g.last[:, :-1], g.last[:, -1])])
    assert (flat == want).all() and tail.tolist() == [1, 2, 3, 4]
