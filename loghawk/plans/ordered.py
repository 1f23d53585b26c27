"""Global order without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one
task.  Here each row gets the number of its range: bounds are taken from a
sample of the sort keys (so a hot group is cut into several ranges), and a
binary search among them is a column.  A window by range and order then does the
sum or the shift natively, its result is written to the checkpoint folder, and
what crosses the ranges comes from a table with one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghawk.session import cut_lineage

#: Sampled keys for each range.
SAMPLE = 40


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def with_range(df: DataFrame, order_cols: list[str], ranges: int, name: str = "__range") -> DataFrame:
    """Add the row's range, 0 .. ``ranges`` - 1, ascending with the order
    (NULLs first).  The sample is the keys of least hash, ``SAMPLE`` a range."""
    key = F.struct(*order_cols)
    some = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE * ranges)
    found = some.agg(F.array_sort(F.collect_list("k")).alias("k"))
    last = F.size("k") - 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(max(ranges - 1, 1))), lambda i: F.get("k", F.floor(i * last / ranges).cast("int")))
    bounds = found.select(F.when(last >= 0, cut).alias("b")).scalar()
    steps, step = [], 1
    while step < ranges:
        steps.insert(0, step)
        step *= 2
    if not steps:
        return df.withColumn(name, F.lit(0))
    # binary search: how many bounds are at or below the key
    n = ranges - 1
    at = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                     lambda lo, s: F.when((lo + s <= n) & (F.get("__bounds", lo + s - 1) <= F.col("__key")), lo + s).otherwise(lo))
    both = df.withColumns({"__bounds": bounds, "__key": key})
    return both.withColumn(name, F.coalesce(at, F.lit(0))).drop("__bounds", "__key")


def with_prefix_sums(df: DataFrame, order_cols: list[str], sum_cols: dict[str, str],
                     num_partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums (doubles) in global ``order_cols`` order.

    ``sum_cols`` maps output name -> input numeric column (use a literal-1
    column for a row index).  The order must be total (add a unique id).
    """
    n = _num_partitions(df, num_partitions)
    outs = list(sum_cols)
    value = {o: F.coalesce(F.col(sum_cols[o]).cast("double"), F.lit(0.0)) for o in outs}
    upto = Window.partitionBy("__range").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = with_range(df, order_cols, n).withColumns({o: F.sum(value[o]).over(upto) for o in outs})
    local = cut_lineage(local, "prefix-sums")
    totals = local.groupBy("__range").agg(*[F.sum(value[o]).alias(f"__t{j}") for j, o in enumerate(outs)])
    # one row per range: a window over it is bounded by the number of ranges
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__t{j}").over(w), F.lit(0.0)).alias(f"__o{j}")
                                         for j in range(len(outs))])
    joined = local.join(F.broadcast(offsets), "__range")
    return joined.select(*df.columns, *[(F.col(o) + F.col(f"__o{j}")).alias(o) for j, o in enumerate(outs)])


def with_global_index(df: DataFrame, order_cols: list[str], name: str = "idx",
                      num_partitions: int | None = None) -> DataFrame:
    """0-based row number in global ``order_cols`` order (order must be total)."""
    ones = df.withColumn("__one", F.lit(1))
    out = with_prefix_sums(ones, order_cols, {name: "__one"}, num_partitions)
    return out.drop("__one").withColumn(name, (F.col(name) - 1).cast("long"))


def with_successor(df: DataFrame, order_cols: list[str], carry_cols: list[str], prefix: str = "next_",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``{prefix}{c}``: the values of the following row in global
    ``order_cols`` order (NULL after the last row); the order must be total.

    Inside a range the successor is a ``lead``.  Only the last row of each range
    needs the next non-empty range's first row, which comes from a table with
    one row per range (broadcast) -- no self-join of the data."""
    n = _num_partitions(df, num_partitions)
    carry = list(dict.fromkeys(carry_cols))
    cols = list(dict.fromkeys(list(order_cols) + carry))
    order = Window.partitionBy("__range").orderBy(*order_cols)
    local = with_range(df.select(*cols), order_cols, n)
    following = F.lead(F.struct(*carry)).over(order)
    local = cut_lineage(local.select("*", following.alias("__next")), "successors")
    firsts = local.groupBy("__range").agg(F.min(F.struct(*order_cols, F.struct(*carry).alias("__carry"))).alias("f"))
    w = Window.orderBy("__range")           # one row per range
    firsts = firsts.select("__range", F.lead("f.__carry").over(w).alias("__first"))
    joined = local.join(F.broadcast(firsts), "__range", "left")
    return joined.select(*df.columns if set(df.columns) <= set(cols) else cols,
                         *[F.coalesce("__next", "__first")[c].alias(prefix + c) for c in carry])
