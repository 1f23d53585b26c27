"""Autoencoder on Spark: full-batch training with one Spark job per epoch,
Arrow-batched scoring.

The rows are packed once into cached blocks.  Epoch job: ``mapInArrow`` walks each
partition's blocks and emits its partial gradient sum, which ``plans.vector_sum.partition_sums`` adds
across partitions with chunked per-position ``sum`` aggregates, so the
driver receives only the summed gradient (a few tens of thousands of
numbers) however large the log is.  The same pass also sums
the evaluation loss of the held-out rows under the current weights.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk.operators import mlp
from loghawk.plans.vector_sum import partition_sums


@dataclass
class AutoencoderModel:
    input_dim: int
    hidden: tuple[int, ...]
    dropout: float
    final: str
    weights: np.ndarray                     # flat parameter vector
    feature_names: list[str] = field(default_factory=list)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    threshold: float | None = None
    history: list[tuple[int, float, float]] = field(default_factory=list)

    def params(self):
        return mlp.unflatten(self.weights, self.input_dim, self.hidden)


#: Layer number under which the hash deals rows to mini-batches; no layer has it.
BATCH_LAYER = 1 << 16


def in_batch(ids: np.ndarray, batch: int, batches: int, seed: int, epoch: int) -> np.ndarray:
    """Rows of a mini-batch: by a hash of the id, dealt anew each epoch."""
    if batches == 1:
        return np.ones(len(ids), bool)
    return np.floor(mlp.hashed_uniform(seed, epoch, BATCH_LAYER, ids, 1)[:, 0] * batches).astype(int) == batch


#: Rows of a block that is worked on at once: its activations stay in a core's cache.
ROWS = 512


def _compact(x: np.ndarray) -> bytes:
    """A block's features (row, feature), bit for bit: a feature with few values in the
    block as their table and a byte a row, the others as they are."""
    cols = np.ascontiguousarray(x.T, dtype=np.float64)
    coded, plain, tables, codes = [], [], [], []
    for k, bits in enumerate(cols.view(np.int64)):
        values, code = np.unique(bits, return_inverse=True)
        if len(values) <= min(256, len(bits) // 4):
            coded.append(k)
            tables.append(values)
            codes.append(code.astype(np.uint8))
        else:
            plain.append(k)
    starts = np.cumsum([0, *map(len, tables)])[:-1]
    table = np.concatenate(tables).view(np.float64) if tables else np.empty(0)
    return pickle.dumps((cols.shape, np.array(coded, int), starts, table, np.array(codes, np.uint8).reshape(len(codes), len(x)), np.array(plain, int), cols[plain]), protocol=5)


def _restored(data) -> pa.Array:
    """``_compact``'s features, a list a row."""
    shape, coded, starts, table, codes, plain, rest = pickle.loads(data)
    cols = np.empty(shape)
    cols[plain] = rest
    if len(coded):
        cols[coded] = table[codes + starts[:, None]]
    d, n = shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(cols.T.ravel()))


def packed(df: DataFrame, partitions: int, features: list[str], id_col: str, split_col: str | None) -> DataFrame:
    """``df`` dealt to ``partitions`` as rows of ``ROWS`` rows each, all of them 'train' rows
    or none: the first of the ``features`` columns (lists of one length) in compact form, the
    others, ``id`` and ``train`` as an Arrow stream in bytes.  Packed once and cached, so that an
    epoch reads arrays and no row is converted again."""
    train = F.coalesce(F.col(split_col) == "train", F.lit(False)) if split_col else F.lit(True)
    # a NULL id is the smallest number
    rows = df.select(*features, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), train.alias("train"))
    dense = features[0]

    def run(batches):
        for batch in batches:
            compact, blocks, train = [], [], batch.column("train")
            for rows in (batch.filter(train), batch.filter(pc.invert(train))):
                for lo in range(0, rows.num_rows, ROWS):
                    part = rows.slice(lo, ROWS)
                    x = part.column(dense).flatten().to_numpy(zero_copy_only=False)
                    compact.append(_compact(x.reshape(part.num_rows, -1)))
                    part = part.drop_columns([dense])
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, part.schema) as stream:
                        stream.write_batch(part)
                    blocks.append(out.getvalue().to_pybytes())
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(compact, pa.binary()), pa.array(blocks, pa.binary())], [dense, "block"])

    return rows.repartition(partitions).mapInArrow(run, T.StructType([T.StructField(dense, T.BinaryType()), T.StructField("block", T.BinaryType())])).persist(StorageLevel.MEMORY_AND_DISK)


def unpacked(batches):
    """The blocks of ``packed``: (record batch, ids, which are 'train' rows: all or none)."""
    for batch in batches:
        dense = batch.schema.names[0]
        for compact, block in zip(batch.column(0), batch.column(1)):
            rows = pa.ipc.open_stream(block.as_buffer()).read_next_batch()
            rows = pa.RecordBatch.from_arrays([_restored(compact.as_buffer()), *rows.columns], [dense, *rows.schema.names])
            yield rows, rows.column("id").to_numpy(), rows.column("train").to_numpy(zero_copy_only=False)


def dense_rows(lists: pa.Array, d: int) -> np.ndarray:
    """A column of feature lists as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def _epoch_job(data: DataFrame, vec: np.ndarray, d: int, hidden, final: str, dropout: float, seed: int, epoch: int,
               features: str, train_grad: bool, batch: int = 0, batches: int = 1):
    """One pass over ``packed`` data: summed gradient of the 'train' rows (of a
    mini-batch) and the loss sums of both parts (train in training mode, test in
    evaluation mode)."""
    n_par = vec.size
    bvec = data.sparkSession.sparkContext.broadcast(vec)

    def partial(chunks):
        net = mlp.Net(mlp.unflatten(bvec.value, d, hidden), final, dropout, seed, epoch)
        g = net.zeros()
        tr_loss = tr_n = te_loss = te_n = 0.0
        for rows, ids, train in unpacked(chunks):
            X, is_train = dense_rows(rows.column(features), d), train[0]
            if is_train and train_grad:
                if batches > 1:
                    mine = in_batch(ids, batch, batches, seed, epoch)
                    X, ids = X[mine], ids[mine]
                if len(ids):
                    tr_loss += net.add_gradient(X, ids, g)
                    tr_n += len(ids)
            elif batch == 0 and not is_train:
                te_loss += float(net.errors(X).sum())
                te_n += len(ids)
        return np.concatenate([net.flat(g), [tr_loss, tr_n, te_loss, te_n]])

    total = partition_sums(data, partial, n_par + 4, arrow=True)
    bvec.unpersist()
    return total[:n_par], total[n_par:]


TRAIN_PARTITION_BYTES = 256 * 1024 ** 2


def training_partitions(df: DataFrame, width: int) -> int:
    """A partition for each 256 MB of doubles (one counting pass; compact blocks are smaller,
    and a task holds one of them), a multiple of the cores, so that no wave of tasks leaves some of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-(df.count() * width * 8) // (TRAIN_PARTITION_BYTES * cores))) * cores


def train_loop(spark, job, theta: np.ndarray, lr: float, epochs: int, batches: int = 1, state_path: str | None = None,
               save_every: int = 5, patience: int | None = None) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """Adam over ``epochs`` of ``batches`` steps.  ``job(theta, epoch, batch,
    with gradient)`` returns the summed gradient and (train loss, train rows, test
    loss, test rows), the sums of the test rows in the first batch.  Returns
    the weights and the history (epoch, train loss, test loss)."""
    opt = mlp.Adam(theta.size, lr)
    history = []
    start, prev_train = 0, None
    lowest, kept, waited = float("inf"), None, 0
    if state_path:
        saved = _load_state(spark, state_path)
        if saved is not None:
            theta, opt.m, opt.v, opt.t, start, prev_train, history = saved
    for epoch in range(start, epochs):
        if state_path and epoch > start and epoch % save_every == 0:
            _save_state(spark, state_path, theta, opt, epoch, prev_train, history)
        loss = rows = 0.0
        stop = False
        for batch in range(batches):
            grad, st = job(theta, epoch, batch, True)
            if batch == 0:
                if epoch > 0 and st[3] > 0:
                    history.append((epoch - 1, float(prev_train), float(st[2] / st[3])))
                if patience is not None and st[3] > 0:
                    if st[2] / st[3] < lowest:
                        lowest, kept, waited = st[2] / st[3], theta.copy(), 0
                    else:
                        waited += 1
                    if waited >= patience:
                        stop = True
                        break
            loss, rows = loss + st[0], rows + st[1]
            if st[1]:
                theta = opt.step(theta, grad / st[1])
        if stop:
            break
        if rows == 0:
            raise ValueError("no training rows")
        prev_train = loss / rows
    else:
        _, st = job(theta, epochs, 0, False)
        history.append((epochs - 1, float(prev_train), float(st[2] / st[3]) if st[3] > 0 else None))
        if kept is not None and st[3] > 0 and st[2] / st[3] < lowest:
            kept = theta
    return theta if kept is None else kept, history


def fit_autoencoder(df: DataFrame, features: str = "features", hidden: tuple[int, ...] = (128, 64, 32),
                    lr: float = 1e-3, epochs: int = 50, dropout: float = 0.2, seed: int = 42,
                    final: str = "relu", id_col: str = "log_id", split_col: str | None = "split",
                    feature_names: list[str] | None = None, num_partitions: int | None = None,
                    state_path: str | None = None, save_every: int = 5, patience: int | None = None,
                    batches: int = 1, init: np.ndarray | None = None) -> AutoencoderModel:
    """Adam on the MSE of the 'train' rows; the 'test' rows give
    the evaluation loss after every epoch (history).  ``df`` holds an
    ``array<double>`` feature column, a unique id and an optional split tag.

    ``batches``: steps an epoch, each a Spark job over its share of the rows
    (1: full batch).  ``init``: weights to start from (by the seed if not given).
    ``state_path`` (a folder under the shared checkpoint directory): every
    ``save_every`` epochs the weights, Adam moments, step and history are
    written there, and a restarted driver resumes from the last save.
    ``patience``: stop after so many epochs without a lower loss of the 'test'
    rows, and return the weights of the lowest."""
    d = len(df.select(features).first()[0])
    # Round-robin once before caching, so that every epoch's numpy work is spread
    # evenly, by the size of the data.
    data = packed(df, num_partitions or training_partitions(df, d), [features], id_col, split_col)
    theta = mlp.flatten(mlp.init_params(d, hidden, seed)) if init is None else np.array(init, dtype=np.float64)

    def job(theta, epoch, batch, train_grad):
        return _epoch_job(data, theta, d, hidden, final, dropout, seed, epoch, features, train_grad, batch, batches)

    try:
        theta, history = train_loop(df.sparkSession, job, theta, lr, epochs, batches, state_path, save_every, patience)
    finally:
        data.unpersist()
    return AutoencoderModel(d, tuple(hidden), dropout, final, theta, list(feature_names or []), history=history)


_STATE_SCHEMA = ("theta array<double>, m array<double>, v array<double>, t int, next_epoch int, "
                 "prev_train double, history array<struct<epoch:int,train_loss:double,test_loss:double>>")


def _save_state(spark, path: str, theta, opt, next_epoch: int, prev_train, history) -> None:
    row = (theta.tolist(), opt.m.tolist(), opt.v.tolist(), int(opt.t), int(next_epoch),
           None if prev_train is None else float(prev_train), [tuple(h) for h in history])
    # a folder for each save: a crash while one is written leaves the one before
    spark.createDataFrame([row], _STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={int(next_epoch)}")


def _load_state(spark, path: str):
    try:
        saved = spark.read.schema(_STATE_SCHEMA + ", epoch int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    r = saved.orderBy(F.desc("epoch")).first()
    if r is None:
        return None
    return (np.array(r["theta"]), np.array(r["m"]), np.array(r["v"]), r["t"], r["next_epoch"], r["prev_train"],
            [(h["epoch"], h["train_loss"], h["test_loss"]) for h in r["history"]])


def history(model: AutoencoderModel, spark) -> DataFrame:
    """Rows ``(epoch, train_loss, test_loss)``."""
    return spark.createDataFrame(model.history, "epoch int, train_loss double, test_loss double")


def _blocks(x: pa.Array, d: int):
    """A column of feature lists as matrices of ``ROWS`` rows."""
    flat = dense_rows(x, d)
    return (flat[lo:lo + ROWS] for lo in range(0, len(flat), ROWS))


def _scorer(model: AutoencoderModel, spark, encode_only: bool):
    bw = spark.sparkContext.broadcast(model.weights)
    d, hidden, final = model.input_dim, model.hidden, model.final

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(x: pa.Array) -> pa.Array:
        net = mlp.Net(mlp.unflatten(bw.value, d, hidden), final)
        out = [net.forward(part, encode_only).T.ravel() for part in _blocks(x, d)]
        flat = np.concatenate(out) if out else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(np.linspace(0, len(flat), len(x) + 1).astype(np.int32)), pa.array(flat))
    return run


def reconstruct(df: DataFrame, model: AutoencoderModel, features: str = "features",
                out: str = "reconstruction") -> DataFrame:
    """Evaluation-mode forward pass over Arrow batches (weights broadcast once)."""
    return df.withColumn(out, _scorer(model, df.sparkSession, False)(F.col(features)))


def with_error(df: DataFrame, model: AutoencoderModel, features: str = "features",
               out: str = "reconstruction_error") -> DataFrame:
    """``df`` with each row's mean squared reconstruction error; the
    reconstruction itself never leaves the Arrow batch."""
    bw = df.sparkSession.sparkContext.broadcast(model.weights)
    d, hidden, final = model.input_dim, model.hidden, model.final

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        net = mlp.Net(mlp.unflatten(bw.value, d, hidden), final)
        return pa.array(np.concatenate([np.empty(0), *(net.errors(part) for part in _blocks(x, d))]))
    return df.withColumn(out, run(F.col(features)))


def encode(df: DataFrame, model: AutoencoderModel, features: str = "features", out: str = "latent") -> DataFrame:
    return df.withColumn(out, _scorer(model, df.sparkSession, True)(F.col(features)))
