"""Sum one numpy vector per partition across the cluster.

``partition_sums(df, fn, size)`` runs ``fn`` over each partition's Arrow
batches (as pandas frames, or as they are with ``arrow``); ``fn`` returns a float vector of ``size``.  The
vectors of few partitions come to the driver as they are, a row each (``DIRECT``
numbers at most).  Those of more leave the tasks in ``CHUNK``-number rows and a hash
aggregate keyed by chunk adds them with one ``sum`` per position (partial aggregation
in every task), so the driver receives only the summed vector -- the pattern
behind every full-batch gradient here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 16
#: Numbers that the driver takes from all partitions together and adds itself (32 MB).
DIRECT = 1 << 22


def partition_sums(df: DataFrame, fn: Callable[[Iterator], np.ndarray], size: int, arrow: bool = False) -> np.ndarray:
    if arrow and df.rdd.getNumPartitions() * size <= DIRECT:
        def whole(batches):
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(fn(batches), dtype=np.float64).tobytes()], pa.binary())], ["v"])

        vectors = df.mapInArrow(whole, "v binary").toArrow().column("v")
        return sum((np.frombuffer(v.as_buffer()) for v in vectors), np.zeros(size))
    n_chunks = (size + CHUNK - 1) // CHUNK
    schema = T.StructType([T.StructField("chunk", T.IntegerType()),
                           T.StructField("v", T.ArrayType(T.DoubleType()))])

    def per_partition(batches):
        vec = np.asarray(fn(batches), dtype=np.float64)
        padded = np.zeros(n_chunks * CHUNK)
        padded[:size] = vec
        chunks = np.arange(n_chunks, dtype=np.int32)
        if arrow:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n_chunks + 1, dtype=np.int32) * CHUNK), pa.array(padded))
            yield pa.RecordBatch.from_arrays([pa.array(chunks), lists], ["chunk", "v"])
        else:
            yield pd.DataFrame({"chunk": chunks, "v": [padded[c * CHUNK:(c + 1) * CHUNK].tolist() for c in range(n_chunks)]})

    rows = ((df.mapInArrow if arrow else df.mapInPandas)(per_partition, schema).groupBy("chunk")
            .agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(CHUNK)]).collect())
    out = np.zeros(n_chunks * CHUNK)
    for r in rows:
        c = r["chunk"]
        out[c * CHUNK:(c + 1) * CHUNK] = [r[f"s{i}"] or 0.0 for i in range(CHUNK)]
    return out[:size]


#: Rows of an Arrow batch that leaves a task of ``slot_sums``.
SLOT_ROWS = 4096


def slot_sums(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sparse form: ``fn`` returns the (slots, rows of ``width`` numbers) that
    its partition has something for, and only those are moved and added.
    Returns the slots that occur, sorted, and their sums.  Where ``fn.most`` tells the slots
    of a partition and they are few, the driver adds them."""
    most = getattr(fn, "most", None)

    def per_partition(batches):
        slots, rows = fn(batches)
        for lo in range(0, len(slots), SLOT_ROWS):
            part = np.ascontiguousarray(rows[lo:lo + SLOT_ROWS], dtype=np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(slots[lo:lo + SLOT_ROWS].astype(np.int64)), lists], ["slot", "v"])

    sums = df.mapInArrow(per_partition, "slot long, v array<double>")
    if most is not None and df.rdd.getNumPartitions() * most * width <= DIRECT:
        out = sums.toArrow()
        slots, at = np.unique(out.column("slot").to_numpy(), return_inverse=True)
        rows = np.zeros((len(slots), width))
        np.add.at(rows, at, out.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width))
        return slots, rows
    out = sums.groupBy("slot").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]).toArrow()
    slots = out.column("slot").to_numpy()
    turn = np.argsort(slots)
    return slots[turn], np.column_stack([out.column(f"s{i}").to_numpy() for i in range(width)])[turn] if len(slots) else np.zeros((0, width))
