"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.llm.common import store


def _with_minimum(pairs: DataFrame, name: str) -> DataFrame:
    """(u, v, m): m is the smallest of u and its neighbours.  The minima are
    a written table, so both join inputs are plain shuffles and a node with
    very many neighbours is split by the adaptive skew join."""
    minima = store(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")), name)
    return pairs.join(minima, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long) -> (node, component): the smallest node id
    reachable.  Nodes without an edge are not listed; self loops and
    repeated edges are ignored.

    Each round links every larger neighbour to the least one (large-star),
    then every smaller neighbour and the node itself to the least (small-star);
    the graph ends as stars.  A round is written to the shared checkpoint
    folder; the driver sees only a row count and a checksum.
    """
    edges = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    before = None
    for i in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, f"cc-large-{i}").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = store(large, f"cc-l-{i}")
        joined = _with_minimum(large, f"cc-small-{i}")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = store(small.where("u <> v").distinct(), f"cc-s-{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
