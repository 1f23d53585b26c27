"""Oracle SQL for small networks: training of an autoencoder and of the
classifier head from given weights, and attention layers, written out as one
expression a weight."""

from __future__ import annotations

#: Adam's constants.
B1, B2, EPS = 0.9, 0.999, 1e-8


def given_weights(n: int) -> list[float]:
    """n small weights of both signs, by position."""
    return [((7 * k + 3) % 19 - 8) / 16 for k in range(n)]


def _adam(n: int, step: int, lr: float, decay: float = 0.0) -> str:
    """CTE w{step}: the weights, moments after the step whose mean gradients are in g{step}."""
    cols = []
    for k in range(n):
        g = f"(g.g{k} + {decay!r} * w.p{k})" if decay else f"g.g{k}"
        m, v = f"({B1!r} * w.m{k} + {1 - B1!r} * {g})", f"({B2!r} * w.v{k} + {1 - B2!r} * {g} * {g})"
        cols.append(f"w.p{k} - {lr!r} * ({m} / {1 - B1 ** step!r}) / (sqrt({v} / {1 - B2 ** step!r}) + {EPS!r}) AS p{k}, {m} AS m{k}, {v} AS v{k}")
    return f", w{step} AS MATERIALIZED (SELECT {', '.join(cols)} FROM w{step - 1} w, g{step} g)"


def _start(init: list[float]) -> str:
    return ", w0 AS MATERIALIZED (SELECT " + ", ".join(f"({x!r})::DOUBLE AS p{k}, 0.0::DOUBLE AS m{k}, 0.0::DOUBLE AS v{k}" for k, x in enumerate(init)) + ")"


def _unpivot(n: int, step: int) -> str:
    return f"SELECT unnest(range({n})) AS position, unnest([{', '.join(f'p{k}' for k in range(n))}]) AS weight FROM w{step}"


def autoencoder_ctes(d: int, h: int, init: list[float], epochs: int, lr: float) -> tuple[str, int]:
    """CTEs w1.. and l0.. (train and test loss under w0..) for a d-h-d network with ReLU
    after both layers, from a CTE x(x0.., train); and the number of weights."""
    n = 2 * d * h + h + d
    w1, b1 = (lambda j, i: f"w.p{j * d + i}"), (lambda j: f"w.p{h * d + j}")
    w2, b2 = (lambda k, j: f"w.p{h * d + h + k * h + j}"), (lambda k: f"w.p{h * d + h + d * h + k}")
    out = _start(init)
    for t in range(epochs + 1):
        z = ", ".join(" + ".join([f"{w1(j, i)} * x{i}" for i in range(d)] + [b1(j)]) + f" AS z{j}" for j in range(h))
        y = ", ".join(" + ".join([f"{w2(k, j)} * greatest(z{j}, 0)" for j in range(h)] + [b2(k)]) + f" AS y{k}" for k in range(d))
        e = ", ".join(f"CASE WHEN y{k} > 0 THEN 2 * (y{k} - x{k}) / {float(d)!r} ELSE 0 END AS e{k}" for k in range(d))
        f = ", ".join("CASE WHEN z%d > 0 THEN %s ELSE 0 END AS f%d" % (j, " + ".join(f"e{k} * {w2(k, j)}" for k in range(d)), j) for j in range(h))
        loss = "(" + " + ".join(f"(greatest(y{k}, 0) - x{k}) ^ 2" for k in range(d)) + f") / {float(d)!r}"
        out += (f", z{t}_ AS (SELECT x.*, {z} FROM x, w{t} w), y{t}_ AS (SELECT z.*, {y} FROM z{t}_ z, w{t} w)"
                f", e{t}_ AS (SELECT y.*, {loss} AS loss, {e} FROM y{t}_ y), f{t}_ AS MATERIALIZED (SELECT e.*, {f} FROM e{t}_ e, w{t} w)"
                f", l{t} AS (SELECT avg(loss) FILTER (WHERE train) AS train_loss, avg(loss) FILTER (WHERE NOT train) AS test_loss FROM f{t}_)")
        if t < epochs:
            grads = ([f"f{j} * x{i}" for j in range(h) for i in range(d)] + [f"f{j}" for j in range(h)]
                     + [f"e{k} * greatest(z{j}, 0)" for k in range(d) for j in range(h)] + [f"e{k}" for k in range(d)])
            out += f", g{t + 1} AS MATERIALIZED (SELECT {', '.join(f'avg({g}) AS g{k}' for k, g in enumerate(grads))} FROM f{t}_ WHERE train)" + _adam(n, t + 1, lr)
    return out, n


def trained_weights(ctes: str, n: int, epochs: int) -> str:
    return ctes + " " + _unpivot(n, epochs)


def loss_history(ctes: str, epochs: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {t} AS epoch, l{t}.train_loss, l{t + 1}.test_loss FROM l{t}, l{t + 1}" for t in range(epochs))
    return f"{ctes} {rows}"


def head_ctes(d: int, h: int, classes: int, init: list[float], epochs: int, lr: float, decay: float = 0.0) -> tuple[str, int]:
    """CTEs w1.., l0.. (loss, accuracy under w0..) and f0.. (with the class probabilities q0..) of the head
    linear-ELU-linear-log-softmax, from a CTE x(x0.., y)."""
    n = h * d + h + classes * h + classes
    at = h * d + h
    out = _start(init)
    for t in range(epochs + 1):
        z = ", ".join(" + ".join([f"w.p{j * d + i} * x{i}" for i in range(d)] + [f"w.p{h * d + j}"]) + f" AS z{j}" for j in range(h))
        a = ", ".join(f"CASE WHEN z{j} > 0 THEN z{j} ELSE exp(z{j}) - 1 END AS a{j}" for j in range(h))
        s = ", ".join(" + ".join([f"w.p{at + c * h + j} * a{j}" for j in range(h)] + [f"w.p{at + classes * h + c}"]) + f" AS s{c}" for c in range(classes))
        top = f"greatest({', '.join(f's{c}' for c in range(classes))})"
        total = "(" + " + ".join(f"exp(s{c} - top)" for c in range(classes)) + ")"
        q = ", ".join(f"exp(s{c} - top) / {total} AS q{c}" for c in range(classes))
        best = "CASE " + " ".join(f"WHEN s{c} = top THEN {c}" for c in range(classes)) + " END"
        ds = ", ".join(f"q{c} - CASE WHEN y = {c} THEN 1 ELSE 0 END AS e{c}" for c in range(classes))
        dz = ", ".join("(%s) * CASE WHEN z%d > 0 THEN 1 ELSE exp(z%d) END AS f%d" % (" + ".join(f"e{c} * w.p{at + c * h + j}" for c in range(classes)), j, j, j) for j in range(h))
        own = "CASE " + " ".join(f"WHEN y = {c} THEN q{c}" for c in range(classes)) + " END"
        out += (f", z{t}_ AS (SELECT x.*, {z} FROM x, w{t} w), a{t}_ AS (SELECT z.*, {a} FROM z{t}_ z), s{t}_ AS (SELECT a.*, {s} FROM a{t}_ a, w{t} w)"
                f", t{t}_ AS (SELECT s.*, {top} AS top FROM s{t}_ s), q{t}_ AS (SELECT t.*, {q}, {best} AS best FROM t{t}_ t)"
                f", e{t}_ AS (SELECT q.*, {ds} FROM q{t}_ q), f{t}_ AS MATERIALIZED (SELECT e.*, {dz} FROM e{t}_ e, w{t} w)"
                f", l{t} AS (SELECT avg(-ln({own})) AS loss, avg(CASE WHEN best = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM f{t}_)")
        if t < epochs:
            grads = ([f"f{j} * x{i}" for j in range(h) for i in range(d)] + [f"f{j}" for j in range(h)]
                     + [f"e{c} * a{j}" for c in range(classes) for j in range(h)] + [f"e{c}" for c in range(classes)])
            out += f", g{t + 1} AS MATERIALIZED (SELECT {', '.join(f'avg({g}) AS g{k}' for k, g in enumerate(grads))} FROM f{t}_)" + _adam(n, t + 1, lr, decay)
    return out, n


def attention_ctes(source: str, name: str, edges: str, w: dict, activation: bool = True) -> str:
    """CTE name(node_id, f0..): an attention layer over source(node_id, f0..) and edges(src, dst), self loops
    and repeats included, with the weights of ``operators.graph.attend``."""
    heads, d_in, width = w["W"].shape
    num = lambda v: f"({float(v)!r})"
    p = [" + ".join(f"{num(w['W'][h, i, j])} * f{i}" for i in range(d_in)) + f" AS p{h}_{j}" for h in range(heads) for j in range(width)]
    t = [" + ".join(f"{num(w[a][h, j])} * p{h}_{j}" for j in range(width)) + f" AS {s}{h}" for a, s in (("att_src", "u"), ("att_dst", "v")) for h in range(heads)]
    raw = ", ".join(f"a.u{h} + b.v{h} AS r{h}" for h in range(heads))
    ps = ", ".join(f"a.p{h}_{j}" for h in range(heads) for j in range(width))
    leaky = ", ".join(f"CASE WHEN r{h} > 0 THEN r{h} ELSE 0.2 * r{h} END AS s{h}" for h in range(heads))
    tops = ", ".join(f"max(s{h}) AS top{h}" for h in range(heads))
    outs = [f"sum(exp(s{h} - top{h}) * p{h}_{j}) / sum(exp(s{h} - top{h})) + {num(w['bias'][h * width + j])} AS f{h * width + j}" for h in range(heads) for j in range(width)]
    act = ", ".join(f"CASE WHEN f{k} > 0 THEN f{k} ELSE exp(f{k}) - 1 END AS f{k}" if activation else f"f{k}" for k in range(heads * width))
    return (f", {name}_p AS (SELECT node_id, {', '.join(p)} FROM {source}), {name}_t AS MATERIALIZED (SELECT *, {', '.join(t)} FROM {name}_p)"
            f", {name}_r AS (SELECT e.dst, {ps}, {raw} FROM {edges} e JOIN {name}_t a ON e.src = a.node_id JOIN {name}_t b ON e.dst = b.node_id)"
            f", {name}_s AS MATERIALIZED (SELECT *, {leaky} FROM {name}_r), {name}_m AS (SELECT dst, {tops} FROM {name}_s GROUP BY dst)"
            f", {name}_o AS (SELECT s.dst AS node_id, {', '.join(outs)} FROM {name}_s s JOIN {name}_m m ON s.dst = m.dst GROUP BY s.dst)"
            f", {name} AS MATERIALIZED (SELECT node_id, {act} FROM {name}_o)")


def normalised_ctes(source: str, name: str, width: int) -> str:
    """CTE name: batch norm over all nodes, then ELU."""
    q = ", ".join(f"avg(f{k}) AS m{k}, var_pop(f{k}) AS v{k}" for k in range(width))
    z = ", ".join(f"(f{k} - m{k}) / sqrt(v{k} + 1e-5) AS f{k}" for k in range(width))
    act = ", ".join(f"CASE WHEN f{k} > 0 THEN f{k} ELSE exp(f{k}) - 1 END AS f{k}" for k in range(width))
    return f", {name}_q AS (SELECT {q} FROM {source}), {name}_z AS (SELECT node_id, {z} FROM {source}, {name}_q), {name} AS (SELECT node_id, {act} FROM {name}_z)"
