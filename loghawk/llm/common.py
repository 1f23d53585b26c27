"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loghawk.session import cut_lineage

#: Java and Python character class of the word separators (space, tab .. carriage return).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it
    back.  The shuffle files behind it are released at once: without the
    collection they would stay on the executors' disks until the driver's
    next full garbage collection."""
    out = cut_lineage(df, name)
    spark = df.sparkSession
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def code_points(col):
    """Length of a text in code points; null counts as empty."""
    return F.coalesce(F.char_length(col), F.lit(0)).cast("long")


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, most_rows: int = 0) -> Iterator[pa.Table]:
    """Re-cut the batches of a partition sorted by ``key`` so that no group
    of equal keys is split.  Yields tables of one or more whole groups; with
    ``most_rows``, a new table is begun after about that many rows."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        same = carry and carry[-1].column(key)[-1].as_py() == keys[-1] and last == 0
        if last or not same:
            done = carry + ([batch.slice(0, last)] if last else [])
            if done:
                yield from _cut(pa.Table.from_batches(done), key, most_rows)
            carry = []
        carry.append(batch.slice(last))
    if carry:
        yield from _cut(pa.Table.from_batches(carry), key, most_rows)


def _cut(t: pa.Table, key: str, most_rows: int) -> Iterator[pa.Table]:
    t = t.combine_chunks()
    if not most_rows or t.num_rows <= most_rows:
        yield t
        return
    keys = t.column(key).to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [t.num_rows]])
    at = 0
    for i in range(1, len(starts)):
        if starts[i] - at >= most_rows or i == len(starts) - 1:
            yield t.slice(at, starts[i] - at)
            at = int(starts[i])


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
