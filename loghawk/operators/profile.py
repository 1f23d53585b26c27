"""Profiling: shape, per-column profile, missing and duplicate shares,
null map, head, histogram, mean/std, value counts.

Each profile is ONE aggregate over the table (partial + final), then one row
per column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk.operators.features import is_numeric


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))


def _text(df: DataFrame, c: str):
    """A value as text, different for different values (-0.0 is 0.0)."""
    col, kind = F.col(_q(c)), df.schema[c].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (col + F.lit(0.0)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(col.isNotNull(), F.to_json(F.struct(col)))
    return col.cast("string")


def _profile_rows(df: DataFrame, found: DataFrame) -> DataFrame:
    """Every column's row, in the table's order, from (column, distinct_values, nulls, rows) of those with rows."""
    kinds = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type")) for i, c in enumerate(df.columns)])
    names = df.sparkSession.range(1).select(F.explode(kinds).alias("k")).select("k.*")
    pct = F.when(F.col("rows") > 0, F.col("nulls") * 100.0 / F.col("rows"))
    return names.join(found, "column", "left").orderBy("at").select(
        "column", "data_type", F.coalesce("distinct_values", F.lit(0)).cast("long").alias("distinct_values"), F.coalesce("nulls", F.lit(0)).cast("long").alias("nulls"), pct.alias("null_pct"))


def profile_columns(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Rows ``(column, data_type, distinct_values, nulls, null_pct)``.

    Exact: (column, value) rows, each value as text, counted in two levels (first
    by value, map-side too, then by column); no row carries more than one value.
    ``approx=True``: ``column_sketches`` of a standard error of ``rsd``, merged: one
    pass, fixed memory."""
    if approx:
        return profile_from_sketches(df, column_sketches(df, rsd=rsd))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _text(df, c).alias("value")) for c in df.columns]))
    values = df.select(each.alias("r")).select("r.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    found = values.groupBy("column").agg(F.count("value").alias("distinct_values"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.sum("n").alias("rows"))
    return _profile_rows(df, found)


def sketch_size(rsd: float) -> int:
    """Base-2 logarithm of the number of buckets for a standard error of ``rsd``."""
    return min(max(math.ceil(2 * math.log2(1.04 / rsd)), 4), 21)


def column_sketches(df: DataFrame, by: list = (), rsd: float = 0.01) -> DataFrame:
    """(by.., column, rows, nulls, sketch): a HyperLogLog sketch of each column's
    values, for each value of ``by`` (columns or expressions with an alias).  Sketches can
    be stored and united later, e.g. of days.  One aggregate, a sketch a column and task."""
    aggs, lg_k = [F.count(F.lit(1)).alias("__n")], sketch_size(rsd)
    for i, c in enumerate(df.columns):
        aggs += [F.hll_sketch_agg(_text(df, c), lg_k).alias(f"__s{i}"), F.count_if(F.col(_q(c)).isNull()).alias(f"__m{i}")]
    one = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    keys = [c for c in one.columns if not c.startswith("__")]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("__n").alias("rows"), F.col(f"__m{i}").alias("nulls"), F.col(f"__s{i}").alias("sketch"))
                               for i, c in enumerate(df.columns)]))
    return one.select(*keys, each.alias("r")).select(*keys, "r.*")


def profile_from_sketches(df: DataFrame, sketches: DataFrame) -> DataFrame:
    """The profile of all rows behind the sketches; ``df`` gives names and types
    only.  A distinct count's standard error is the sketches' ``rsd`` of it."""
    united = sketches.groupBy("column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).alias("distinct_values"), F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows"))
    return _profile_rows(df, united)


def missing_pct(df: DataFrame) -> DataFrame:
    """One row: NULL cells / (rows x columns) x 100."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    n = F.count(F.lit(1)) * len(df.columns)
    return df.agg(F.when(n > 0, nulls * 100.0 / n).alias("missing_pct"))


def duplicate_pct(df: DataFrame) -> DataFrame:
    """One row: rows after the first of each identical group / rows x 100
    (NULLs equal).  Group-by on all columns with map-side combine."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    total = F.sum("__c")
    return groups.agg(total.alias("rows"), (total - F.count(F.lit(1))).alias("duplicates"),
                      F.when(total > 0, (total - F.count(F.lit(1))) * 100.0 / total).alias("duplicate_pct"))


def type_counts(df: DataFrame) -> DataFrame:
    """Rows ``(data_type, columns, non_null_cells)`` per data type plus the
    'group:numeric' and 'group:string' rows: the grouping comes from the schema, the
    cell counts from one aggregate over the table."""
    groups: dict[str, list[str]] = {}
    for f in df.schema.fields:
        groups.setdefault(f.dataType.simpleString(), []).append(f.name)
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    string = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    named = sorted(groups.items()) + [("group:numeric", numeric), ("group:string", string)]
    aggs = [sum((F.count(F.col(_q(c))) for c in cols), F.lit(0)).cast("long").alias(f"g{i}")
            for i, (_, cols) in enumerate(named)]
    rows = ", ".join(f"'{t}', CAST({len(cols)} AS BIGINT), g{i}" for i, (t, cols) in enumerate(named))
    return df.agg(*aggs).selectExpr(f"stack({len(named)}, {rows}) AS (data_type, columns, non_null_cells)")


def null_map(df: DataFrame, cols: list[str], buckets: int = 20, id_col: str = "log_id") -> DataFrame:
    """Where NULLs sit along the id axis: rows ``(bucket, column, nulls)``,
    ``buckets`` equal id ranges.  Two aggregates: min/max, then counts."""
    mm = df.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi"))
    lo, hi = mm.select("lo").scalar(), mm.select("hi").scalar()
    b = F.least(F.floor((F.col(id_col) - lo) * buckets / (hi - lo + 1)), F.lit(buckets - 1)).cast("int")
    agg = df.groupBy(b.alias("bucket")).agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    return agg.selectExpr("bucket", f"stack({len(cols)}, {rows}) AS (column, nulls)")


def head(df: DataFrame, n: int = 5, id_col: str = "log_id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max] of the finite values; the last bin is
    closed; empty bins are kept (count 0).  A constant column gives one full bin.
    NULL and NaN don't count; infinite values are two more rows where they occur: bin -1
    from -inf, and bin ``bins`` up to inf."""
    spark = df.sparkSession
    x = F.col(col).cast("double")
    vals = df.select(x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    inf = float("inf")
    finite = F.when(F.abs("v") < inf, F.col("v"))
    mm = vals.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count_if(F.col("v") == -inf).alias("under"), F.count_if(F.col("v") == inf).alias("over")).first()
    lo, hi = mm["lo"], mm["hi"]
    outside = [(-1, -inf, lo, mm["under"])] * (mm["under"] > 0) + [(bins, hi, inf, mm["over"])] * (mm["over"] > 0)
    outside = spark.createDataFrame(outside, "bin int, bin_start double, bin_end double, count long")
    if lo is None:
        return outside
    vals = vals.where(F.abs("v") < inf)
    if not hi - lo < inf:       # the span is beyond a double: halves
        half = vals.select((F.col("v") / 2).alias("v"))
        twice = histogram(half, "v", bins).select("bin", (F.col("bin_start") * 2).alias("bin_start"), (F.col("bin_end") * 2).alias("bin_end"), "count")
        return twice.unionByName(outside)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int") if hi > lo else F.lit(0)
    counts = vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")).unionByName(outside))


def mean_std(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows ``(column, mean, std)`` with the sample std (pandas ``.std()``)."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"a{i}"), F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}")]
    rows = ", ".join(f"'{c}', a{i}, s{i}" for i, c in enumerate(cols))
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {rows}) AS (column, mean, std)")


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """Most frequent non-NULL values, count desc then value (TakeOrdered)."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("value")).limit(k))
