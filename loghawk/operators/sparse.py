"""One-hot features of large vocabularies in sparse form (FE7, AE1).

The vocabulary is a table (value, index) with dense indices, made and joined by
Spark; nothing of it passes the driver but its size.  A row's one-hots are the
indices and values that aren't zero.  The autoencoder's input and
output are the dense features followed by a position for each value of the
vocabulary: its first layer reads, and gets a gradient for, the positions that
occur; its last layer is worked off in blocks of positions, so a task never holds
rows times vocabulary.  The loss and the weights are those of the dense form.

The driver and each task hold the network (2 * vocabulary * first hidden width
numbers), never rows of the log.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.operators import mlp
from loghawk.operators.autoencoder import ROWS, AutoencoderModel, dense_rows, in_batch, packed, train_loop, training_partitions, unpacked
from loghawk.operators.features import endpoint_vocabulary
from loghawk.plans.joins import lookup_join
from loghawk.plans.ordered import with_global_index
from loghawk.plans.vector_sum import slot_sums

#: Positions of the last layer that are worked on at once.
BLOCK = 4096


def indexed_vocabulary(df: DataFrame, col: str) -> DataFrame:
    """``(value, index)``: the distinct non-null values in sorted order, from 0."""
    return with_global_index(endpoint_vocabulary(df, col), ["value"], "index")


def one_hot_indices(df: DataFrame, vocabularies: dict[str, DataFrame], indices: str = "indices", values: str = "values") -> tuple[DataFrame, int]:
    """Add the sparse one-hots of several columns: ``indices`` (array<int>,
    ascending) and ``values`` (1.0 each).  A column's indices follow those of the one
    before.  NULL and values outside the vocabulary have none.  Returns
    (df, number of positions)."""
    out, at, parts = df, 0, []
    for n, (col, vocabulary) in enumerate(vocabularies.items()):
        index = f"__index{n}"
        known = vocabulary.select(F.col("value").alias(col), (F.col("index") + at).cast("int").alias(index))
        out = lookup_join(out, known, col, "left")
        parts.append(F.col(index))
        at += vocabulary.count()
    out = out.withColumn(indices, F.array_compact(F.array(*parts)) if parts else F.array().cast("array<int>"))
    out = out.withColumn(values, F.transform(indices, lambda i: F.lit(1.0)))
    return out.drop(*[f"__index{n}" for n in range(len(parts))]), at


class SparseRows:
    """Dense features, and the positions (behind them) and values of the rest."""

    def __init__(self, dense: np.ndarray, counts: np.ndarray, positions: np.ndarray, values: np.ndarray):
        self.dense, self.counts, self.positions, self.values = dense, counts, positions, values
        self.ends = np.cumsum(counts)

    @staticmethod
    def of(dense: np.ndarray, indices: pa.Array, values: pa.Array) -> "SparseRows":
        """From the dense features and Arrow columns of lists."""
        positions, numbers = (x.flatten().to_numpy(zero_copy_only=False) for x in (indices, values))
        counts = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return SparseRows(dense, counts, positions.astype(np.int64) + dense.shape[1], numbers.astype(np.float64))

    def take(self, mask: np.ndarray) -> "SparseRows":
        each = np.repeat(mask, self.counts)
        return SparseRows(self.dense[mask], self.counts[mask], self.positions[each], self.values[each])

    def cut(self, lo: int, hi: int) -> "SparseRows":
        a, b = (self.ends[lo - 1] if lo else 0), (self.ends[hi - 1] if hi else 0)
        return SparseRows(self.dense[lo:hi], self.counts[lo:hi], self.positions[a:b], self.values[a:b])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def times(self, columns: np.ndarray) -> np.ndarray:
        """The rows times a matrix, given transposed: positions x width."""
        out = self.dense @ columns[: self.dense.shape[1]]
        some = np.flatnonzero(self.counts)
        if len(some):
            starts = (self.ends - self.counts)[some]
            out[some] += np.add.reduceat(self.values[:, None] * columns[self.positions], starts, axis=0)
        return out

    def block(self, first: int, end: int) -> np.ndarray:
        """Positions first..end-1 as a dense matrix (position, row)."""
        out = np.zeros((end - first, len(self.counts)))
        d = self.dense.shape[1]
        if first < d:
            out[: min(d, end) - first] = self.dense[:, first:end].T
        here = (self.positions >= first) & (self.positions < end)
        np.add.at(out, (self.positions[here] - first, self.rows()[here]), self.values[here])
        return out


class SparseNet(mlp.Net):
    """Forward and backward pass over sparse rows, with the same result as
    ``mlp.Net`` over their dense form."""

    def __init__(self, theta: np.ndarray, width: int, hidden: tuple[int, ...], final: str = "relu", block: int = BLOCK,
                 dropout: float = 0.0, seed: int = 0, epoch: int = 0):
        params = mlp.unflatten(theta, width, hidden)
        super().__init__(params, final, dropout, seed, epoch)
        self.width, self.block = width, block
        self.columns = np.ascontiguousarray(params[0][0].T)

    def _first(self, x: SparseRows) -> np.ndarray:
        """The first layer before its activation, and the row of ones."""
        out = self._array(("output", 0), self.columns.shape[1] + 1, len(x.counts))
        out[:-1] = x.times(self.columns).T
        out[:-1] += self.weights[0][:, -1:]
        out[-1] = 1.0
        return out

    def _evaluated(self, x: SparseRows, layers: int) -> np.ndarray:
        """The first ``layers`` without dropout, and the row of ones."""
        a = self._first(x)
        for li, W in enumerate(self.weights[:layers]):
            a = self._product(li, W, a) if li else a
            np.maximum(a[:-1], 0.0, out=a[:-1])
        return a

    def _ranges(self) -> list[tuple[int, int]]:
        return [(first, min(first + self.block, self.width)) for first in range(0, self.width, self.block)]

    def errors(self, x: SparseRows) -> np.ndarray:
        """Each row's mean squared reconstruction error."""
        a = self._evaluated(x, len(self.weights) - 1)
        out = np.zeros(len(x.counts))
        for first, end in self._ranges():
            z = self.weights[-1][first:end] @ a
            diff = (z if self.final == "linear" else np.maximum(z, 0.0, out=z)) - x.block(first, end)
            out += np.einsum("dn,dn->n", diff, diff)
        return out / self.width

    def encode(self, x: SparseRows) -> np.ndarray:
        return self._evaluated(x, len(self.weights) // 2)[:-1].T

    def add_gradient(self, x: SparseRows, ids, total: "Gradient") -> float:
        """Add the gradient of the rows' loss; returns the loss."""
        last = len(self.trained) - 1
        outs = [self._first(x)]
        kept = [self._activate(0, outs[0][:-1], ids, True)]
        for li in range(1, last):
            outs.append(self._product(li, self.trained[li], outs[-1]))
            kept.append(self._activate(li, outs[-1][:-1], ids, True))
        a = outs[-1]
        loss, back = 0.0, np.zeros((len(a) - 1, a.shape[1]))
        for first, end in self._ranges():
            W = self.trained[last][first:end]
            g = W @ a
            cut = self._activate(last, g, ids, self.final != "linear", first)
            if self.dropout > 0:
                g *= self.scale
            g -= x.block(first, end)
            loss += float(np.vdot(g, g))
            g *= 2.0 * self.scale / self.width
            if cut is not None:
                g *= cut
            total.last[first:end] += g @ a.T
            back += W[:, :-1].T @ g
        g = np.multiply(back, kept[-1], out=back)
        for li in reversed(range(last)):
            if li:
                added = g @ outs[li - 1].T
                total.middle[li] += added[:, :-1]
                total.biases[li] += added[:, -1]
                g = self._back(li, g, kept[li - 1])
        total.biases[0] += g.sum(axis=1)
        d = x.dense.shape[1]
        total.first[:d] += (g @ x.dense).T
        if len(x.positions):        # the rows of a position side by side, each position once
            turn = np.argsort(x.positions, kind="stable")
            occur, starts = np.unique(x.positions[turn], return_index=True)
            by_row = np.ascontiguousarray(g.T)
            total.first[occur] += np.add.reduceat(x.values[turn, None] * by_row[x.rows()[turn]], starts, axis=0)
            total.seen[occur] = True
        return loss / self.width


class Gradient:
    """Sums of a gradient, as slots of ``width + 1`` numbers: a row for each input
    position that occurs (the first layer's column), one for each output position (the
    last layer's row and bias), and the rest in pieces."""

    def __init__(self, width: int, dense: int, hidden: tuple[int, ...]):
        self.sizes = mlp.layer_sizes(width, hidden)
        self.width, h = width, hidden[0]
        self.first, self.last = np.zeros((width, h)), np.zeros((width, h + 1))
        self.seen = np.zeros(width, bool)
        self.seen[:dense] = True
        self.middle = {li: np.zeros((fo, fi)) for li, (fi, fo) in enumerate(self.sizes) if 0 < li < len(self.sizes) - 1}
        self.biases = [np.zeros(fo) for _, fo in self.sizes[:-1]]

    def slots(self, tail: list[float], scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """``scale``: what the nets' passes left out of the inputs of all layers but the first."""
        self.last[:, :-1] *= scale
        for m in self.middle.values():
            m *= scale
        n = self.last.shape[1]
        occur = np.flatnonzero(self.seen)
        rest = np.concatenate([*(m.ravel() for m in self.middle.values()), *self.biases, tail])
        pieces = np.zeros(-(-len(rest) // n) * n)
        pieces[: len(rest)] = rest
        pieces = pieces.reshape(-1, n)
        first = np.column_stack([self.first[occur], np.zeros(len(occur))])
        slots = np.concatenate([occur, self.width + np.arange(self.width), 2 * self.width + np.arange(len(pieces))])
        return slots, np.concatenate([first, self.last, pieces])

    def load(self, slots: np.ndarray, rows: np.ndarray, n_tail: int) -> tuple[np.ndarray, np.ndarray]:
        """(flat gradient, tail) of summed slots."""
        w = self.width
        at = np.searchsorted(slots, [w, 2 * w])
        self.first[slots[: at[0]]] = rows[: at[0], :-1]
        self.last[slots[at[0]:at[1]] - w] = rows[at[0]:at[1]]
        rest = rows[at[1]:].ravel()
        k = 0
        for m in [*self.middle.values(), *self.biases]:
            m.ravel()[:] = rest[k:k + m.size]
            k += m.size
        layers = [(self.first.T, self.biases[0])] + [(m, self.biases[li]) for li, m in self.middle.items()] + [(self.last[:, :-1], self.last[:, -1])]
        return mlp.flatten(layers), rest[k:k + n_tail]


def _sparse_epoch(data: DataFrame, theta: np.ndarray, dense: int, width: int, hidden, final: str, dropout: float, seed: int,
                  epoch: int, batch: int, batches: int, train_grad: bool, cols: list[str], block: int):
    sent = data.sparkSession.sparkContext.broadcast(theta)
    features, indices, values = cols

    def partial(chunks):
        net, total = SparseNet(sent.value, width, hidden, final, block, dropout, seed, epoch), Gradient(width, dense, hidden)
        sums = np.zeros(4)
        for rows, ids, train in unpacked(chunks):
            x = SparseRows.of(dense_rows(rows.column(features), dense), rows.column(indices), rows.column(values))
            if train[0] and train_grad:
                if batches > 1:
                    mine = in_batch(ids, batch, batches, seed, epoch)
                    x, ids = x.take(mine), ids[mine]
                if len(ids):
                    sums[0] += net.add_gradient(x, ids, total)
                    sums[1] += len(ids)
            elif batch == 0 and not train[0]:
                sums[2] += net.errors(x).sum()
                sums[3] += len(ids)
        return total.slots(sums.tolist(), net.scale)

    # the positions of the first and last layer, and the other weights in pieces
    partial.most = 2 * width + theta.size // (hidden[0] + 1) + 1
    slots, rows = slot_sums(data, partial, hidden[0] + 1)
    sent.unpersist()
    return Gradient(width, dense, hidden).load(slots, rows, 4)


def fit_sparse_autoencoder(df: DataFrame, positions: int, features: str = "features", indices: str = "indices", values: str = "values",
                           hidden: tuple[int, ...] = (128, 64, 32), lr: float = 1e-3, epochs: int = 50, dropout: float = 0.2,
                           seed: int = 42, final: str = "relu", id_col: str = "log_id", split_col: str = "split",
                           feature_names: list[str] | None = None, state_path: str | None = None, save_every: int = 5,
                           patience: int | None = None, batches: int = 1, init: np.ndarray | None = None, block: int = BLOCK) -> AutoencoderModel:
    """``fit_autoencoder`` for rows of dense ``features`` and one-hots in sparse form
    (``positions``: the size of the vocabularies).  The weights have the order of the
    dense form: its input is the dense features, then the positions."""
    dense = len(df.select(features).first()[0])
    width = dense + positions
    cols = [features, indices, values]
    data = packed(df, training_partitions(df, dense + 4), cols, id_col, split_col)
    theta = mlp.flatten(mlp.init_params(width, hidden, seed)) if init is None else np.array(init, dtype=np.float64)

    def job(theta, epoch, batch, train_grad):
        return _sparse_epoch(data, theta, dense, width, tuple(hidden), final, dropout, seed, epoch, batch, batches, train_grad, cols, block)

    try:
        theta, history = train_loop(df.sparkSession, job, theta, lr, epochs, batches, state_path, save_every, patience)
    finally:
        data.unpersist()
    return AutoencoderModel(width, tuple(hidden), dropout, final, theta, list(feature_names or []), history=history)


def with_sparse_error(df: DataFrame, model: AutoencoderModel, features: str = "features", indices: str = "indices", values: str = "values",
                      out: str = "reconstruction_error") -> DataFrame:
    """``df`` with each row's mean squared reconstruction error over all positions."""
    sent = df.sparkSession.sparkContext.broadcast(model.weights)
    width, hidden, final = model.input_dim, model.hidden, model.final
    dense = len(model.feature_names)

    @F.arrow_udf("double")
    def run(x: pa.Array, i: pa.Array, v: pa.Array) -> pa.Array:
        net, rows = SparseNet(sent.value, width, hidden, final), SparseRows.of(dense_rows(x, dense), i, v)
        return pa.array(np.concatenate([np.empty(0), *(net.errors(rows.cut(lo, min(lo + ROWS, len(x)))) for lo in range(0, len(x), ROWS))]))

    return df.withColumn(out, run(features, indices, values))
