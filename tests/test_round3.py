"""The findings of round 3, one test or more for each."""

from conftest import SF001


def test_classify_search_reaches_its_trials(spark, monkeypatch):
    """F2, F8: the query cuts the lineage of both parts and hands every row to the search."""
    import __spark_entry__ as E
    from loghawk.operators import classify as CL
    from loghawk.sources.tables import read_table

    def search(train, valid, **how):
        ids = [{r[0] for r in part.select("log_id").collect()} for part in (train, valid)]
        assert how == {"n_trials": 20, "max_iter": 50} and not ids[0] & ids[1]
        return len(ids[0]) + len(ids[1])

    monkeypatch.setattr(CL, "search", search)
    assert E.queries()["classify_search"](spark, SF001) == read_table(spark, SF001, "embeddings").count()


class Handle:
    """The state and timers of one IP, for ``IdleTotals``."""

    def __init__(self):
        self.value, self.timers, self.reads = None, set(), 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.reads += 1
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_one_timer_ends_all_totals_that_are_over():
    """an IP with many open totals has one timer, and one call emits all that the watermark has passed."""
    from types import SimpleNamespace

    import pandas as pd

    from loghawk.streaming.idle import IdleTotals

    second, handle = 1_000_000, Handle()
    totals = IdleTotals(10 * second)
    totals.init(handle)
    first = [100 * n * second for n in range(50)]
    list(totals.handleInputRows(("a",), iter([pd.DataFrame({"first_micros": first, "last_micros": first, "requests": 2})]), None))
    assert handle.timers == {10_000}
    handle.timers.clear()
    now = SimpleNamespace(getExpiryTimeInMs=lambda: 10_000, getCurrentWatermarkInMs=lambda: 4_000_000)
    out = [r for pdf in totals.handleExpiredTimer(("a",), now, now) for r in pdf.itertuples(index=False)]
    assert [r.first_request.timestamp() for r in out] == [100 * n for n in range(40)] and {r.requests for r in out} == {2}
    assert handle.timers == {4_010_000} and handle.reads == 2
    # a request that joins the one that ends first moves the timer
    joined = pd.DataFrame({"first_micros": [4_005 * second], "last_micros": [4_005 * second], "requests": [1]})
    list(totals.handleInputRows(("a",), iter([joined]), None))
    assert handle.timers == {4_015_000}
    end = SimpleNamespace(getExpiryTimeInMs=lambda: 4_015_000, getCurrentWatermarkInMs=lambda: 9_000_000)
    handle.timers.clear()
    out = [r for pdf in totals.handleExpiredTimer(("a",), end, end) for r in pdf.itertuples(index=False)]
    assert [r.requests for r in out] == [3] + [2] * 9 and handle.value is None and not handle.timers


def test_requests_meet_the_count_of_their_own_window_only(spark, tmp_path):
    """the start of the window is a key of the join, so its pairs don't grow with an IP's windows."""
    from loghawk.streaming import streams as ST

    spark.range(3).selectExpr("'a' AS ip_address", "timestamp_seconds(id * 400 + 500) AS request_time").write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema("ip_address string, request_time timestamp").parquet(f"{tmp_path}/in/*")
    path, query = ST.run_to_table(ST.with_window_counts(stream, delay="10 minutes"), "keys", base=str(tmp_path))
    plan = query._jsq.explainInternal(False)
    join = next(line for line in plan.splitlines() if "StreamingSymmetricHashJoin" in line)
    assert "__start" in join.split("Inner")[0], join
    spark.createDataFrame([("z", "2100-01-01 00:00:00")], "ip_address string, t string").selectExpr("ip_address", "CAST(t AS TIMESTAMP) AS request_time").write.parquet(f"{tmp_path}/in/1")
    ST.run_to_table(ST.with_window_counts(stream, delay="10 minutes"), "keys", base=str(tmp_path))
    assert [r[0] for r in spark.read.parquet(path).where("ip_address = 'a'").select("requests_in_window").collect()] == [1, 1, 1]


def test_dropout_factor_is_that_of_the_hash():
    """the integer comparison cuts exactly the units that the floats cut."""
    import numpy as np

    from loghawk.operators import mlp

    ids = np.concatenate([np.arange(500), [-(1 << 63), (1 << 62) + 7, -5]]).astype(np.int64)
    for dropout in (0.1, 0.2, 0.37, 0.5, 0.9):
        want = (mlp.hashed_uniform(3, 7, 2, ids, 60, 5) >= dropout) / (1.0 - dropout)
        assert (mlp.dropout_factor(dropout, 3, 7, 2, ids, 60, 5) == want).all()


def test_training_rows_are_derived_and_packed_once(spark, monkeypatch):
    """The features are written once and every epoch reads blocks of whole rows; NULL ids are test rows."""
    import numpy as np
    from pyspark.sql import functions as F

    from loghawk.operators import autoencoder as AE
    from loghawk.plans import detection
    from loghawk.sources.tables import api_log

    seen = {}

    def fit(df, **how):
        seen["plan"] = df._jdf.queryExecution().optimizedPlan().toString()
        seen["rows"] = df.count()
        return AE.AutoencoderModel(len(how["feature_names"]), (2,), 0.0, "relu", np.zeros(4 * len(how["feature_names"]) + 2 + len(how["feature_names"])))

    monkeypatch.setattr(detection.AE, "fit_autoencoder", fit)
    log = api_log(spark, SF001)
    detection.train_detector(log)
    assert "Join" not in seen["plan"] and seen["rows"] == log.count()

    df = spark.range(2000).select(F.when(F.col("id") != 7, F.col("id")).alias("log_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("features"),
                                  F.when(F.col("id") % 5 > 0, "train").alias("split"))
    data = AE.packed(df, 3, ["features"], "log_id", "split")
    got = {}
    for rows, ids, train in AE.unpacked([data.toArrow()]):
        assert len(ids) <= AE.ROWS
        got |= {int(x[0]): (int(i), bool(t)) for x, i, t in zip(rows.column("features").to_pylist(), ids, train)}
    data.unpersist()
    assert got == {n: (n if n != 7 else -(1 << 63), n % 5 > 0) for n in range(2000)}


def test_whole_graphs_equal_the_tables(spark, monkeypatch):
    """graphs worked off in their task give what the joins give; repeated ids, large graphs and edges between graphs go by the joins."""
    import numpy as np
    from pyspark.sql import functions as F

    from loghawk.operators import graph_search as GS

    rng = np.random.default_rng(8)
    nodes, edges, at = [], [], 0
    for g in range(25):
        n = int(rng.integers(1, 9))
        nodes += [(at + i, g, rng.normal(size=2).tolist()) for i in range(n)]
        edges += [p for i in range(n - 1) for p in ((at + i, at + i + 1), (at + i + 1, at + i))] + [(at, at + n - 1)] * 2
        at += n
    nodes += [nodes[0], (None, 3, [1.0, 2.0]), (at + 1, None, [0.5, 0.5])]
    edges += [(nodes[5][0], nodes[60][0]), (nodes[60][0], 10_000)]
    nodes = spark.createDataFrame(nodes, "node_id long, graph_id long, features array<double>")
    edges = spark.createDataFrame(edges, "src long, dst long")
    trials = [GS.Trial(0, 32, 3, 0.0, 1, "add", 0.01, 0.0, False, False), GS.Trial(1, 64, 2, 0.2, 2, "mean", 0.02, 1e-4, True, True),
              GS.Trial(5, 96, 2, 0.3, 3, "add", 0.01, 1e-5, False, True)]
    weights = {t.trial: t.weights(2, 4) for t in trials}
    monkeypatch.setattr(GS, "GRAPH_NODES", 7)
    monkeypatch.setattr(GS, "BLOCK_NODES", 10)
    small, rest = GS.whole_graphs(nodes, edges)
    assert small.count() and rest.count() and small.count() + rest.count() == 25
    got = {(r.trial, r.graph_id): r.pooled for r in GS.pooled_search(nodes, edges, trials, 2, weights).collect()}
    want = {(r.trial, r.graph_id): r.pooled for r in GS.pooled_trials(GS.stacked_trials(nodes, edges, trials, 4), nodes, trials).collect()}
    assert got.keys() == want.keys() and len(want) == 3 * 26
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    # what a task works off is not moved
    called = []
    monkeypatch.setattr(GS, "attention_sums", lambda *a: called.append(1))
    inside = F.col("graph_id").isin([r.graph_id for r in small.collect()])
    assert GS.pooled_search(nodes.where(inside & F.col("node_id").isNotNull()), edges, trials, 2, weights).count() and not called


def test_partitions_are_a_multiple_of_the_cores(spark):
    """no wave of training tasks leaves cores idle."""
    from loghawk.operators import autoencoder as AE

    cores = spark.sparkContext.defaultParallelism
    at = lambda n: AE.training_partitions(spark.range(n), AE.TRAIN_PARTITION_BYTES // 8 // 100)
    assert [at(n) for n in (1, 100 * cores, 100 * cores + 1)] == [cores, cores, 2 * cores]


def test_blocks_are_compact_and_of_one_part(spark):
    """a block's features come back bit for bit from far fewer bytes, and its rows are all for training or none."""
    import numpy as np

    from loghawk.operators import autoencoder as AE

    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 3, 512) / 3.0, rng.integers(0, 2, 512), rng.normal(size=512), np.full(512, -0.0)])
    x[5, 2], x[6, 0] = np.nan, np.inf
    back = AE.dense_rows(AE._restored(AE._compact(x)), 4)
    assert (back.view(np.int64) == x.view(np.int64)).all() and len(AE._compact(x)) < 0.5 * x.nbytes
    for n in (0, 1, 5):
        assert (AE.dense_rows(AE._restored(AE._compact(x[:n])), 4).view(np.int64) == x[:n].view(np.int64)).all()

    df = spark.createDataFrame([(i, x[i].tolist(), "train" if i % 3 else "test") for i in range(200)], "log_id long, features array<double>, split string")
    data = AE.packed(df, 2, ["features"], "log_id", "split")
    parts = [(ids.tolist(), train) for _, ids, train in AE.unpacked([data.toArrow()])]
    data.unpersist()
    assert all(train.all() or not train.any() for _, train in parts)
    assert sorted(i for ids, _ in parts for i in ids) == list(range(200))


def test_net_passes_equal_the_plain_formulas():
    """the passes in parts of units, whose arrays are used again, give the plain gradient, block after block."""
    import numpy as np

    from loghawk.operators import mlp

    rng = np.random.default_rng(4)
    params = mlp.init_params(6, (9, 5), 3)
    for final in ("relu", "linear"):
        for dropout in (0.0, 0.3):
            net = mlp.Net(params, final, dropout, 11, 2)
            total, want, loss, plain = net.zeros(), 0.0, 0.0, 0.0
            for n in (7, 40, 3):
                X, ids = rng.normal(size=(n, 6)), rng.integers(-2**63, 2**63 - 1, n)
                loss += net.add_gradient(X, ids, total)
                acts, factors = [X], []
                for li, (W, b) in enumerate(params):
                    z = acts[-1] @ W.T + b
                    f = (mlp.hashed_uniform(11, 2, li, ids, len(b)) >= dropout) / (1 - dropout)
                    if li < len(params) - 1 or final == "relu":
                        f = f * (z > 0)
                    acts.append(z * f)
                    factors.append(f)
                plain += ((acts[-1] - X) ** 2).sum() / 6
                g, grads = 2 * (acts[-1] - X) / 6, []
                for li in reversed(range(len(params))):
                    g = g * factors[li]
                    grads.insert(0, (g.T @ acts[li], g.sum(axis=0)))
                    g = g @ params[li][0]
                want = want + mlp.flatten(grads)
                y = mlp.forward(X, params, final)
                assert np.allclose(net.errors(X), ((X - y) ** 2).mean(axis=1), rtol=1e-12)
            assert np.allclose(net.flat(total), want, rtol=1e-9, atol=1e-12) and abs(loss - plain) < 1e-9


def test_training_derives_its_features_once(spark, monkeypatch):
    """the scaler and the training rows come from the stored features, the log is not read again for the scaler."""
    from loghawk.operators import autoencoder as AE
    from loghawk.plans import detection
    from loghawk.sources.tables import api_log

    seen = []
    monkeypatch.setattr(detection, "fit_scaler", lambda df, names, keep=detection.fit_scaler: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, names))
    log = api_log(spark, SF001)
    model, spec = detection.train_detector(log, epochs=1, hidden=(4,))
    sparse, sparse_spec, _ = detection.train_sparse_detector(log, epochs=1, hidden=(4,))
    assert len(seen) == 2 and not any("Join" in plan for plan in seen)
    _, same_spec, scaler = detection.prepare(log)
    assert spec.names == same_spec.names and {k: [round(x, 9) for x in v] for k, v in model.scaler.items()} == {k: [round(x, 9) for x in v] for k, v in scaler.params.items()}
    assert AE.encode(detection.prepare(log.limit(5), spec, scaler)[0], model).count() == 5


def test_sums_of_few_and_of_many_partitions(spark, monkeypatch):
    """vectors that come to the driver as they are add up like those of the aggregate."""
    import numpy as np

    from loghawk.plans import vector_sum as VS

    df = spark.range(1000).repartition(5)
    fn = lambda batches: np.arange(40) * float(sum(b.column(0).to_numpy().sum() for b in batches))

    def slots(batches):
        ids = np.concatenate([b.column(0).to_numpy() for b in batches])
        return np.unique(ids % 7), np.column_stack([np.bincount(ids % 7, minlength=7)] * 3)[np.unique(ids % 7)]

    slots.most = 7
    few, few_slots = VS.partition_sums(df, fn, 40, arrow=True), VS.slot_sums(df, slots, 3)
    monkeypatch.setattr(VS, "DIRECT", 10)
    many, many_slots = VS.partition_sums(df, fn, 40, arrow=True), VS.slot_sums(df, slots, 3)
    assert (few == many).all() and few[1] == 499500
    assert (few_slots[0] == many_slots[0]).all() and (few_slots[1] == many_slots[1]).all() and few_slots[1][:, 0].sum() == 1000


def test_elu_by_table():
    """the table's ELU is that of the formula, and NaN and infinity come through."""
    import numpy as np

    from loghawk.operators import graph_search as GS

    x = np.concatenate([np.random.default_rng(1).normal(size=20_000) * 5, -np.logspace(-18, 3, 5000), [0.0, -0.0, np.inf, -np.inf]]).reshape(-1, 4)
    want = np.where(x > 0, x, np.expm1(np.minimum(x, 0)))
    assert np.allclose(GS._elu(x), want, rtol=0, atol=4e-16) and np.allclose(GS._elu(x.T), want.T, rtol=0, atol=4e-16)
    assert np.isnan(GS._elu(np.array([[np.nan, -1.0]]))).tolist() == [[True, False]]
