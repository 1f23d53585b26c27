"""Small numpy MLP used inside Spark tasks: forward, backward, hashed dropout.

Runs on executors over Arrow batches; nothing here sees more than one batch.
"""

from __future__ import annotations

import math

import numpy as np

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def hashed_uniform(seed: int, epoch: int, layer: int, ids: np.ndarray, width: int, first: int = 0) -> np.ndarray:
    """U[0,1) per (row id, unit), a pure function of (seed, epoch, layer, id,
    unit): the same mask whatever the partitioning.  Units ``first`` and on."""
    with np.errstate(over="ignore"):
        base = _mix(np.uint64(seed) * _GOLD + np.uint64(epoch) * _M1 + np.uint64(layer) * _M2)
        rows = _mix(ids.astype(np.uint64) ^ base)[:, None]
        units = _mix(np.arange(first, first + width, dtype=np.uint64) * _GOLD + base)[None, :]
        h = _mix(rows ^ units)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


#: Numbers that are worked on at once: they stay in a core's cache.
PART = 32768


def _hash_parts(seed: int, epoch: int, layer: int, ids: np.ndarray, width: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """What ``_mix`` of a row's and a unit's hash goes on from, after its first step, which is that of each."""
    with np.errstate(over="ignore"):
        base = _mix(np.uint64(seed) * _GOLD + np.uint64(epoch) * _M1 + np.uint64(layer) * _M2)
        units = _mix(np.arange(first, first + width, dtype=np.uint64) * _GOLD + base)
        rows = _mix(ids.astype(np.uint64) ^ base)
    return rows ^ (rows >> np.uint64(30)), units ^ (units >> np.uint64(30))


def _kept(rows: np.ndarray, units: np.ndarray, least: np.uint64, h: np.ndarray, t: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The hash of some units (unit, row), compared in place; ``h`` and ``t`` are arrays to use."""
    np.bitwise_xor(units[:, None], rows, out=h)
    np.multiply(h, _M1, out=h)
    np.right_shift(h, np.uint64(27), out=t)
    np.bitwise_xor(h, t, out=h)
    np.multiply(h, _M2, out=h)
    np.right_shift(h, np.uint64(31), out=t)
    np.bitwise_xor(h, t, out=h)
    return np.greater_equal(h, least, out=out)


def _least(dropout: float) -> np.uint64:
    """The hash from which on a unit is kept: its top 53 bits are compared as integers."""
    return np.uint64(math.ceil(dropout * (1 << 53)) << 11)


def dropout_kept(dropout: float, seed: int, epoch: int, layer: int, ids: np.ndarray, width: int, first: int = 0) -> np.ndarray:
    """``hashed_uniform(...) >= dropout``, transposed (unit, row), without the floats between."""
    rows, units = _hash_parts(seed, epoch, layer, ids, width, first)
    out = np.empty((width, len(ids)), bool)
    step = max(1, PART // max(1, len(ids)))
    work = np.empty((2, min(step, width), len(ids)), np.uint64)
    for lo in range(0, width, step):
        m = min(step, width - lo)
        _kept(rows, units[lo:lo + m], _least(dropout), work[0, :m], work[1, :m], out[lo:lo + m])
    return out


def dropout_factor(dropout: float, seed: int, epoch: int, layer: int, ids: np.ndarray, width: int, first: int = 0) -> np.ndarray:
    """``(hashed_uniform(...) >= dropout) / (1 - dropout)``."""
    return np.multiply(dropout_kept(dropout, seed, epoch, layer, ids, width, first).T, 1.0 / (1.0 - dropout), order="C")


def layer_sizes(d: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    """(fan_in, fan_out) of the symmetric encoder-decoder stack."""
    dims = [d, *hidden]
    enc = [(dims[i], dims[i + 1]) for i in range(len(hidden))]
    dec = [(dims[i + 1], dims[i]) for i in reversed(range(len(hidden)))]
    return enc + dec


def init_params(d: int, hidden: tuple[int, ...], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Uniform(-1/sqrt(fan_in), 1/sqrt(fan_in)) weights and biases; W is (out, in)."""
    rng = np.random.default_rng(seed)
    out = []
    for fi, fo in layer_sizes(d, hidden):
        lim = 1.0 / np.sqrt(fi)
        out.append((rng.uniform(-lim, lim, (fo, fi)), rng.uniform(-lim, lim, fo)))
    return out


def flatten(params) -> np.ndarray:
    return np.concatenate([np.concatenate([W.ravel(), b]) for W, b in params])


def unflatten(vec: np.ndarray, d: int, hidden: tuple[int, ...]):
    out, k = [], 0
    for fi, fo in layer_sizes(d, hidden):
        W = vec[k:k + fi * fo].reshape(fo, fi)
        k += fi * fo
        b = vec[k:k + fo]
        k += fo
        out.append((W, b))
    return out


class Net:
    """Passes over blocks of rows with the same weights.  A layer's activations are
    transposed (unit, row), so that each pass runs along the rows, and end in a row of ones,
    which the biases go by; their arrays serve the next block again."""

    def __init__(self, params, final: str = "relu", dropout: float = 0.0, seed: int = 0, epoch: int = 0):
        self.final, self.dropout, self.seed, self.epoch = final, dropout, seed, epoch
        self.scale = 1.0 / (1.0 - dropout)
        self.weights = [np.column_stack([W, b]) for W, b in params]
        # the dropout's 1 / (1 - dropout) is left out of a layer's output; the next layer's weights have it
        self.trained = [np.column_stack([W * self.scale if li else W, b]) for li, (W, b) in enumerate(params)] if dropout > 0 else self.weights
        self._held: dict = {}

    def _array(self, name, rows: int, n: int, dtype=np.float64) -> np.ndarray:
        held = self._held.get(name)
        if held is None or held.size < rows * n:
            held = self._held[name] = np.empty(rows * n, dtype)
        return held[:rows * n].reshape(rows, n)

    def _input(self, X: np.ndarray) -> np.ndarray:
        a = self._array("input", X.shape[1] + 1, len(X))
        a[:-1] = X.T
        a[-1] = 1.0
        return a

    def _product(self, li: int, W: np.ndarray, a: np.ndarray) -> np.ndarray:
        """A layer before its activation, and the row of ones."""
        out = self._array(("output", li), len(W) + 1, a.shape[1])
        np.matmul(W, a, out=out[:-1])
        out[-1] = 1.0
        return out

    def forward(self, X: np.ndarray, encode_only: bool = False) -> np.ndarray:
        """Evaluation: the output (unit, row), valid until the next block."""
        a = self._input(X)
        for li, W in enumerate(self.weights[:len(self.weights) // 2 if encode_only else None]):
            a = self._product(li, W, a)
            if li < len(self.weights) - 1 or self.final != "linear":
                np.maximum(a[:-1], 0.0, out=a[:-1])
        return a[:-1]

    def errors(self, X: np.ndarray) -> np.ndarray:
        """Each row's mean squared reconstruction error."""
        diff = self.forward(X)
        diff -= X.T
        return np.einsum("dn,dn->n", diff, diff) / X.shape[1]

    def _parts(self, units: int, n: int) -> list[slice]:
        """Some units at once, whose numbers stay in a core's cache."""
        step = max(1, PART // max(1, n))
        return [slice(lo, min(lo + step, units)) for lo in range(0, units, step)]

    def _activate(self, li: int, act: np.ndarray, ids, relu: bool, first: int = 0) -> np.ndarray | None:
        """Training: cuts ``act`` by the ReLU and the dropout (units ``first`` and on), whose
        factor is left out; returns where neither cut, or None."""
        if not relu and self.dropout == 0:
            return None
        units, n = act.shape
        kept, parts = self._array(("kept", li), units, n, bool), self._parts(units, n)
        h, t = (self._array(x, parts[0].stop, n, np.uint64) for x in ("hash", "shifted"))
        positive = self._array("positive", parts[0].stop, n, bool)
        if self.dropout > 0:
            hashed, unit = _hash_parts(self.seed, self.epoch, li, ids, units, first)
        for p in parts:
            m = p.stop - p.start
            if relu:
                np.greater(act[p], 0.0, out=positive[:m] if self.dropout > 0 else kept[p])
            if self.dropout > 0:
                _kept(hashed, unit[p], _least(self.dropout), h[:m], t[:m], kept[p])
                if relu:
                    np.logical_and(kept[p], positive[:m], out=kept[p])
            np.multiply(act[p], kept[p], out=act[p])
        return kept

    def _back(self, li: int, g: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """The gradient of the layer before's activations, cut like them."""
        W = self.trained[li][:, :-1].T
        back = self._array(("back", li), len(W), g.shape[1])
        for p in self._parts(*back.shape):
            np.matmul(W[p], g, out=back[p])
            np.multiply(back[p], kept[p], out=back[p])
        return back

    def trained_layers(self, X: np.ndarray, ids) -> tuple[np.ndarray, list]:
        """Training: the output without the last dropout's factor, and (input, kept) of each layer."""
        a, cache = self._input(X), []
        for li, W in enumerate(self.trained):
            out = self._product(li, W, a)
            cache.append((a, self._activate(li, out[:-1], ids, li < len(self.trained) - 1 or self.final != "linear")))
            a = out
        return a[:-1], cache

    def zeros(self) -> list[np.ndarray]:
        """A sum of gradients to add to."""
        return [np.zeros(W.shape) for W in self.weights]

    def add_gradient(self, X: np.ndarray, ids, total: list[np.ndarray]) -> float:
        """Add the gradient of the rows' MSE to ``total``; returns the sum of the rows' MSE."""
        g, cache = self.trained_layers(X, ids)
        d = X.shape[1]
        if self.dropout > 0:
            g *= self.scale
        g -= cache[0][0][:-1]
        loss = float(np.vdot(g, g) / d)
        g *= 2.0 * self.scale / d
        if cache[-1][1] is not None:
            g *= cache[-1][1]
        for li in reversed(range(len(cache))):
            total[li] += np.matmul(g, cache[li][0].T, out=self._array(("gradient", li), *total[li].shape))
            if li:
                g = self._back(li, g, cache[li - 1][1])
        return loss

    def flat(self, total: list[np.ndarray]) -> np.ndarray:
        """The sum of gradients as a vector like the weights'."""
        return flatten([(g[:, :-1] * self.scale if li else g[:, :-1], g[:, -1]) for li, g in enumerate(total)])


def forward(X: np.ndarray, params, final: str = "relu", dropout: float = 0.0, ids: np.ndarray | None = None,
            seed: int = 0, epoch: int = 0, encode_only: bool = False):
    """ReLU after every layer (the last too unless ``final='linear'``);
    dropout after every layer when ``dropout > 0`` (training)."""
    net = Net(params, final, dropout, seed, epoch)
    return net.trained_layers(X, ids)[0].T * net.scale if dropout > 0 else net.forward(X, encode_only).T


def loss_and_grad(X: np.ndarray, params, final: str = "relu", dropout: float = 0.0, ids=None, seed: int = 0,
                  epoch: int = 0):
    """Sum over rows of the per-row MSE and of its gradient (flattened)."""
    net = Net(params, final, dropout, seed, epoch)
    loss = net.add_gradient(X, ids, total := net.zeros())
    return loss, net.flat(total)


class Adam:
    """Adam (beta 0.9/0.999, eps 1e-8) on a flat parameter vector, driver-side."""

    def __init__(self, n: int, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.lr, self.b1, self.b2, self.eps = lr, b1, b2, eps
        self.m, self.v, self.t = np.zeros(n), np.zeros(n), 0

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = self.b1 * self.m + (1 - self.b1) * grad
        self.v = self.b2 * self.v + (1 - self.b2) * grad * grad
        mh = self.m / (1 - self.b1 ** self.t)
        vh = self.v / (1 - self.b2 ** self.t)
        return theta - self.lr * mh / (np.sqrt(vh) + self.eps)


# ------------------------------------------------ classifier head (ELU) ----
def init_head(d_in: int, hidden: int, classes: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    out = []
    for fi, fo in ((d_in, hidden), (hidden, classes)):
        lim = 1.0 / np.sqrt(fi)
        out.append((rng.uniform(-lim, lim, (fo, fi)), rng.uniform(-lim, lim, fo)))
    return out


def head_sizes(d_in: int, hidden: int, classes: int) -> list[tuple[int, int]]:
    return [(d_in, hidden), (hidden, classes)]


def unflatten_sizes(vec: np.ndarray, sizes: list[tuple[int, int]]):
    out, k = [], 0
    for fi, fo in sizes:
        W = vec[k:k + fi * fo].reshape(fo, fi)
        k += fi * fo
        out.append((W, vec[k:k + fo]))
        k += fo
    return out


def head_forward(X: np.ndarray, params, dropout: float = 0.0, ids=None, seed: int = 0, epoch: int = 0,
                 keep_cache: bool = False):
    """linear -> ELU -> dropout -> linear -> log-softmax."""
    (W1, b1), (W2, b2) = params
    z1 = X @ W1.T + b1
    a1 = np.where(z1 > 0, z1, np.expm1(np.minimum(z1, 0)))
    mask = None
    if dropout > 0:
        mask = dropout_factor(dropout, seed, epoch, 0, ids, a1.shape[1])
        a1 = a1 * mask
    z2 = a1 @ W2.T + b2
    z2 = z2 - z2.max(axis=1, keepdims=True)
    logp = z2 - np.log(np.exp(z2).sum(axis=1, keepdims=True))
    return (logp, (z1, a1, mask)) if keep_cache else logp


def head_loss_and_grad(X: np.ndarray, y: np.ndarray, params, dropout: float = 0.0, ids=None, seed: int = 0,
                       epoch: int = 0):
    """Sums over rows: NLL, correct predictions, and the NLL gradient (flat)."""
    (W1, b1), (W2, b2) = params
    logp, (z1, a1, mask) = head_forward(X, params, dropout, ids, seed, epoch, keep_cache=True)
    n = len(X)
    loss = float(-logp[np.arange(n), y].sum())
    correct = float((logp.argmax(axis=1) == y).sum())
    dz2 = np.exp(logp)
    dz2[np.arange(n), y] -= 1.0
    gW2, gb2 = dz2.T @ a1, dz2.sum(axis=0)
    da1 = dz2 @ W2
    if mask is not None:
        da1 = da1 * mask
    dz1 = da1 * np.where(z1 > 0, 1.0, np.exp(np.minimum(z1, 0)))
    gW1, gb1 = dz1.T @ X, dz1.sum(axis=0)
    return loss, correct, flatten([(gW1, gb1), (gW2, gb2)])
