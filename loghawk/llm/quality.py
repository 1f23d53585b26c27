"""Quality classifier: naive Bayes support vectors (operator 8).

Features are indicators: which byte pairs and (hashed) byte triples a text
holds, and which bins its figures fall in (repeated words, capitals, marks, word
lengths).  Log-count ratios of the classes are counted over all labelled rows
of the training part.  They scale the indicators, on which a linear hinge-loss
model is fitted by dual coordinate descent, over a bounded sample of these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk.llm.common import store, utf8

PAIRS, TRIPLES = 1 << 16, 1 << 17
#: Figures of a text and the bounds of their bins.
BINS = {
    "adjacent": (0.001, 0.01, 0.03, 0.1, 0.3, 0.6), "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), "capital": (0.001, 0.01, 0.03, 0.1, 0.3, 0.6),
    "mark": (0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32), "length": (1.5, 2.5, 3.5, 4.5, 5.5, 7, 10, 20), "words": (1, 4, 16, 64, 256, 1024, 4096),
}
STEP = 16
SIZE = PAIRS + TRIPLES + STEP * len(BINS)
CAPITAL, MARK = np.zeros(256, bool), np.ones(256, bool)
CAPITAL[65:91] = True
MARK[[*range(9, 14), 32, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(raw: bytes, flags: np.ndarray) -> np.ndarray:
    """Sorted feature numbers of a whole text; ``flags`` is a zeroed array of SIZE that is zeroed again."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) > 1:
        two = (b[:-1] << 8) | b[1:]
        flags[two] = True
        three = ((two[:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)
        flags[PAIRS + (three >> 15)] = True
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    view = np.frombuffer(raw, np.uint8)
    figures = (sum(map(eq, words, words[1:])) / n, len(set(words)) / n, CAPITAL[view].sum() / size, MARK[view].sum() / size, (len(raw) - n) / n, len(words))
    for i, (x, bounds) in enumerate(zip(figures, BINS.values())):
        flags[PAIRS + TRIPLES + STEP * i + int(np.searchsorted(bounds, x, "right"))] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


COUNTED = "feature int, bad long, good long, features binary, label int, pick long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, label, pick, sampled): the features of the sampled rows, and, at
    the end of a task, the number of its rows of each class with each feature."""
    counts, flags, none = np.zeros((2, SIZE), np.int64), np.zeros(SIZE, bool), pa.nulls
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [])
        for text, label, pick, sampled in zip(utf8(batch.column(0)), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
            ids = features(text, flags)
            counts[label, ids] += 1
            if sampled:
                for out, x in zip(rows, (ids.astype("<i4").tobytes(), label, pick)):
                    out.append(x)
        n = len(rows[0])
        yield pa.RecordBatch.from_arrays([none(n, pa.int32()), none(n, pa.int64()), none(n, pa.int64()), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())],
                                         ["feature", "bad", "good", "features", "label", "pick"])
    some = np.flatnonzero(counts.sum(axis=0))
    n = len(some)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some]), none(n, pa.binary()), none(n, pa.int32()), none(n, pa.int64())],
                                     ["feature", "bad", "good", "features", "label", "pick"])


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 8) -> np.ndarray:
    """Weights of the linear hinge-loss model on unit-length rows of scaled
    indicators; ``cost`` bounds each row's dual variable."""
    w, alpha, rng = np.zeros(len(scale)), np.zeros(len(rows)), np.random.default_rng(seed)
    values = [scale[r] / max(float(np.linalg.norm(scale[r])), 1e-12) for r in rows]
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * float(w[rows[i]] @ values[i]) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through the margins (Newton steps, smoothed targets)."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, 0.99, 0.01)
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-3 * np.array([a, 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return max(float(a), 1e-6), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000, smoothing: float = 1.0) -> dict:
    """Model from the labelled rows whose crc32(id as text) mod 3 is not 1.

    Counts are over all of these.  The hinge-loss fit takes at most
    ``most_rows`` of them, half of each class where there are as many, those
    of the smallest hash of the id.  Labels other than 0 and 1 don't count.
    Without rows of both classes the model gives every text the same score.
    """
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1).withColumn("pick", F.xxhash64(F.lit(8), "id"))
    # the hash below which most_rows / 2 of a class lie
    below = [known.where(F.col("label") == c).orderBy("pick").limit(most_rows // 2).agg(F.max("pick")).first()[0] for c in (0, 1)]
    if None in below:
        total = known.agg(F.avg("label")).first()[0]
        return {"constant": 1.0 if total is None else float(total)}
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = texts.where("id is not null").where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    sampled = F.when(F.col("label") == 0, F.col("pick") <= below[0]).otherwise(F.col("pick") <= below[1])
    # merged at every size: a plan that broadcasts the labels while they are few tells nothing about a larger run
    rows = texts.join(known.hint("merge"), "id").select("text", "label", "pick", sampled)
    made = store(rows.mapInArrow(_count, COUNTED), "qu-counts")
    counted = made.where("feature is not null").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = np.zeros((2, SIZE))
    for part in counted.toPandas().itertuples(index=False):      # at most SIZE rows
        counts[0, part.feature], counts[1, part.feature] = part.bad, part.good
    p, q = counts[1] + smoothing, counts[0] + smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    sample = sorted((r.pick, bytes(r.features), r.label) for r in made.where("features is not null").select("features", "label", "pick").collect())
    if len({r[2] for r in sample}) < 2:
        return {"constant": float(counts[1].sum() > 0)}
    ids = [np.frombuffer(r[1], "<i4") for r in sample]
    y = np.array([1.0 if r[2] else -1.0 for r in sample])
    share = {c: float((y == c).mean()) for c in (-1.0, 1.0)}
    weight = np.array([0.5 / share[c] for c in y])
    w = dual_coordinate_descent(ids, y, ratio, 1.0 * weight)
    model = {"weight": (w * ratio).astype(np.float32), "ratio2": (ratio ** 2).astype(np.float32)}
    a, b = _calibrate(np.array([margin(i, model) for i in ids]), y, weight)
    return model | {"slope": a, "intercept": b}


def margin(ids: np.ndarray, model: dict) -> float:
    return float(model["weight"][ids].sum(dtype=np.float64)) / max(float(model["ratio2"][ids].sum(dtype=np.float64)) ** 0.5, 1e-12)


def _scores(model: dict, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(SIZE, bool)
        for batch in batches:
            if "constant" in model:
                out = [model["constant"]] * batch.num_rows
            else:
                x = np.array([margin(features(x, flags), model) for x in utf8(batch.column("text"))], float)
                out = 1 / (1 + np.exp(-np.clip(model["slope"] * x + model["intercept"], -500, 500)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.float64())], [*keep, "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each input row.

    ``held_out``: crc32(doc_id as text) mod 3 is 1; false for a null id.
    Scores depend on the whole text alone; null counts as empty, and an empty
    text gets the model's score of a text without n-grams.  Rows that repeat
    are answered each.  Extra columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col, most_rows)
    some = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    made = some.mapInArrow(_scores(model, ("doc_id",)), "doc_id long, score double")
    return made.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns, whatever their names."""
    model = fit(docs, labels, id_col, text_col, label_col, most_rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    some = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())])
    return some.mapInArrow(_scores(model, ("row",)), schema).where("score >= 0.5").select("row.*")
