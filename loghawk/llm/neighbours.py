"""Approximate nearest neighbours by a forest of random-projection trees (operator 2).

The trees are grown on a bounded sample; every vector is then routed down each
tree to a leaf.  A query walks all trees at once with one priority queue, which
gives the leaves in order of how near the query comes to their side of the cuts,
until they hold enough vectors.  Leaves meet their queries in tasks, which
rank the leaf's vectors by exact distance and pass on each query's nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.common import sorted_groups, store

NEAREST = 10


class Tree:
    """Arrays over the inner nodes: normal, offset, children (negative: leaf -1 - c)."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        todo = [(np.arange(len(points)), -1, 0)]
        self.root = 0
        while todo:
            rows, parent, side = todo.pop()
            cut = self._cut(points[rows], rng) if len(rows) > leaf else None
            if cut is None:
                me = -1 - self.leaves
                self.leaves += 1
            else:
                me = len(self.normals)
                normal, offset, right = cut
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append([0, 0])
                todo += [(rows[~right], me, 0), (rows[right], me, 1)]
            if parent >= 0:
                self.children[parent][side] = me
            else:
                self.root = me
        dims = points.shape[1]
        self.normal = np.array(self.normals, np.float32).reshape(-1, dims)
        self.offset = np.array(self.offsets, np.float32)
        self.child = np.array(self.children, np.int64).reshape(-1, 2)
        del self.normals, self.offsets, self.children

    @staticmethod
    def _cut(x: np.ndarray, rng: np.random.Generator):
        """A random projection, cut at the sample's median; none if that parts nothing."""
        for _ in range(3):
            normal = rng.standard_normal(x.shape[1]).astype(np.float32)
            normal /= max(float(np.linalg.norm(normal)), 1e-12)
            p = x @ normal
            offset = float(np.median(p))
            right = p > offset
            if right.any() and not right.all():
                return normal, offset, right
        return None

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.full(len(x), self.root, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            p = np.einsum("ij,ij->i", x[inner], self.normal[node])
            at[inner] = self.child[node, (p > self.offset[node]).astype(np.int64)]
        return -1 - at


def walk(trees: list[Tree], sizes: list[np.ndarray], q: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the queue's order, over all trees, until they hold ``wanted`` vectors."""
    margins = [t.normal @ q - t.offset for t in trees]
    heap = [(0.0, i, t.root) for i, t in enumerate(trees)]
    heapq.heapify(heap)
    out, held = [], 0
    while heap and held < wanted:
        far, i, node = heapq.heappop(heap)
        while node >= 0:
            m = margins[i][node]
            near = int(m > 0)
            other = trees[i].child[node, 1 - near]
            heapq.heappush(heap, (max(far, abs(float(m))), i, int(other)))
            node = int(trees[i].child[node, near])
        leaf = -1 - node
        if sizes[i][leaf]:
            out.append((i, leaf))
            held += int(sizes[i][leaf])
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _route(trees: list[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v")).astype(np.float32)
            for i, t in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array((i << 32) + t.route(x)), batch.column("vec_id"), pa.array([-1] * len(x), pa.int64()), batch.column("v")], ["place", "vec_id", "query_id", "v"])

    return run


def _walk(trees: list[Tree], sizes: list[np.ndarray], wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            for row, (q, me) in enumerate(zip(x, batch.column("vec_id").to_pylist())):
                places = [(i << 32) + leaf for i, leaf in walk(trees, sizes, q.astype(np.float32), wanted)]
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([-1] * n, pa.int64()), pa.array([me] * n, pa.int64()), batch.column("v").take(pa.array([row] * n, pa.int64()))], ["place", "vec_id", "query_id", "v"])

    return run


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest of each leaf for each of its queries, by exact distance."""
    for t in sorted_groups(batches, "place", 1):
        asks, ids = t.column("query_id").to_numpy(), t.column("vec_id").to_numpy()
        if not (asks < 0).any():
            continue
        x = _matrix(t.column("v")).astype(np.float64)
        mine = np.flatnonzero(asks < 0)
        mine = mine[np.argsort(ids[mine], kind="stable")]       # ties go to the smaller id
        points, names = x[mine], ids[mine]
        out: tuple[list, ...] = ([], [], [])
        norms = (points ** 2).sum(axis=1)
        asking = np.flatnonzero(asks >= 0)
        for lo in range(0, len(asking), 256):
            some = asking[lo : lo + 256]
            rough = norms - 2 * (x[some] @ points.T)        # squared distance less the query's own square
            least = np.partition(rough, min(NEAREST, len(points) - 1), axis=1)[:, min(NEAREST, len(points) - 1)]
            slack = 1e-9 * (1 + np.abs(norms).max(initial=0) + (x[some] ** 2).sum(axis=1))
            for row, i in enumerate(some):
                near = np.flatnonzero(rough[row] <= least[row] + slack[row])
                d = np.sqrt(((points[near] - x[i]) ** 2).sum(axis=1))
                turn = np.argsort(d, kind="stable")
                turn = turn[names[near[turn]] != asks[i]][:NEAREST]
                out[0].append(np.full(len(turn), asks[i]))
                out[1].append(names[near[turn]])
                out[2].append(d[turn])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])


#: Leaves that a tree has at least, so that in small tables too a query chooses among many.
LEAVES = 80


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 100, trees: int = 24, sample_rows: int = 20_000,
            leaf_rows: int = 256, search_share: float = 0.8, search_rows: int = 0, seed: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the 10 nearest found of each row whose
    id is divisible by ``query_every``, among all rows but those of its own id.

    The forest is grown on at most ``sample_rows`` vectors, those of the
    smallest hash of the id; every vector is in the index.  Of equal vectors
    only the 11 of smallest id can be among a query's 10 nearest, so the
    others aren't routed, and a vector of very many copies stays one small
    group.  A query reads leaves that hold ``search_share`` of all vectors
    (at least ``search_rows``, if given), counted in all trees: for vectors without
    clusters, as in ``embeddings``, a recall of 0.9 takes that much at every size.

    Rows with a null id, and vectors null, empty, zero, or with null or
    non-finite components, take no part; neither do those whose length isn't
    the commonest one (the greater, if tied).  Rows that repeat an id count
    once, the smallest vector.  Extra columns are ignored.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = store(rows.where(F.size("v") == lengths.d).groupBy("vec_id").agg(F.min("v").alias("v")), "nn-rows")
    total = rows.count()
    order = Window.partitionBy(F.xxhash64("v"), F.hash("v")).orderBy("vec_id")
    index = store(rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= NEAREST + 1).drop("n"), "nn-index")
    picked = index.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample_rows).select("v").toPandas()["v"]
    sample = np.array(picked.tolist(), np.float32)
    leaf = max(2, int(min(leaf_rows, total / LEAVES) * len(sample) / max(total, 1)))
    forest = [Tree(sample, leaf, seed * 1000 + i) for i in range(trees)]
    routed = store(index.mapInArrow(_route(forest), "place long, vec_id long, query_id long, v array<double>"), "nn-places")
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for place, n in routed.groupBy("place").count().collect():      # at most one row a leaf, bounded by the sample
        sizes[place >> 32][place & 0xFFFFFFFF] = n
    wanted = max(search_rows, int(search_share * sizes[0].sum()), trees * 2 * (NEAREST + 1))
    asked = rows.where(F.col("vec_id") % query_every == 0).mapInArrow(_walk(forest, sizes, wanted), "place long, vec_id long, query_id long, v array<double>")
    met = routed.union(asked).repartition("place").sortWithinPartitions("place")
    found = met.mapInArrow(_rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= NEAREST)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
