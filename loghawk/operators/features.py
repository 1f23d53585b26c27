"""Scalar feature operators (narrow projections, no shuffle) and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk.functions.columns import (IPV4_PATTERN, OCTET_PATTERNS, UA_FLAG_PATTERNS, STATUS_CLASSES,
                                       ip_octet, qcol, status_class_columns, time_part_columns, ua_flag)
from loghawk.operators.schema import ROLE_KEYWORDS

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def parse_time(df: DataFrame, col: str, fmt: str | None = None) -> DataFrame:
    """String to timestamp; unparsable values become NULL and the row stays."""
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return df
    if isinstance(dt, T.StringType):
        parsed = F.try_to_timestamp(F.col(col), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(col))
        return df.withColumn(col, parsed)
    if isinstance(dt, T.DateType):
        return df.withColumn(col, F.col(col).cast("timestamp"))
    # Numbers: the name-only rule reads integers as epoch nanoseconds (pandas default).
    return df.withColumn(col, F.timestamp_micros((F.col(col) / 1000).cast("long")))


def time_features(df: DataFrame, col: str) -> DataFrame:
    """``{col}_hour``, ``{col}_day``, ``{col}_dayofweek`` (Monday = 0)."""
    return df.withColumns(time_part_columns(col, col))


def has_ipv4(df: DataFrame, col: str) -> DataFrame:
    """One row: does any value contain a dotted quad?"""
    return df.agg(F.coalesce(F.bool_or(F.col(col).rlike(IPV4_PATTERN)), F.lit(False)).alias("has_ipv4"))


def any_ipv4(df: DataFrame, col: str) -> bool:
    """Driver-side test for the batch plan: reads partitions, few first, until one has a match."""
    return bool(df.select(col).where(F.col(col).rlike(IPV4_PATTERN)).take(1))


def ip_octets(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({f"{col}_{name}": ip_octet(col, name) for name in OCTET_PATTERNS})


def ua_flags(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({f"{col}_{flag}": ua_flag(col, flag) for flag in UA_FLAG_PATTERNS})


def _stack_totals(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """One aggregate pass, then a stack: (label, total, pct)."""
    n = F.count(F.lit(1))
    aggs = [F.sum(qcol(c)).cast("long").alias(c) for c in names] + [n.alias("__n")]
    one = df.agg(*aggs)
    rows = ", ".join(f"'{c}', `{c}`" for c in names)
    return (one.selectExpr(f"stack({len(names)}, {rows}) AS ({label}, total)", "__n")
            .select(label, F.coalesce("total", F.lit(0)).cast("long").alias("total"),
                    F.when(F.col("__n") > 0, F.col("total") * 100.0 / F.col("__n")).alias("pct")))


def ua_totals(df: DataFrame, col: str) -> DataFrame:
    """Rows ``(flag, total, pct)`` for the four agent flags."""
    flagged = ua_flags(df.select(col), col)
    return _stack_totals(flagged, [f"{col}_{f}" for f in UA_FLAG_PATTERNS], "flag")


def endpoint_vocabulary(df: DataFrame, col: str) -> DataFrame:
    """``(value)``: the distinct non-null values, one row each."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()


def one_hot(df: DataFrame, col: str, values: list[str] | None = None,
            prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """0/1 column ``{col}_endpoint_{value}`` per vocabulary value; NULL and
    values outside the vocabulary give all zeros.  Returns (df, vocabulary);
    keep the vocabulary so new data gets the same columns.  One column a
    value means that the names are part of the plan, so the driver must know
    them; for values by the million use ``one_hot_rows``."""
    prefix = prefix or f"{col}_endpoint"
    if values is None:
        values = sorted(r[0] for r in endpoint_vocabulary(df, col).collect())
    c = F.col(col)
    return df.withColumns({f"{prefix}_{v}": F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)) for v in values}), list(values)


def one_hot_rows(df: DataFrame, col: str, vocabulary: DataFrame, id_col: str = "log_id",
                 prefix: str | None = None) -> DataFrame:
    """The one-hot in sparse form, ``(id, hot)``: the name of the one column
    that is 1, NULL where all are 0.  ``vocabulary`` is a (stored) table
    ``(value)`` of any size; nothing of it passes the driver."""
    prefix = prefix or f"{col}_endpoint"
    known = vocabulary.select(F.col("value").alias(col), F.concat(F.lit(f"{prefix}_"), "value").alias("hot"))
    return df.select(id_col, col).join(known, col, "left").select(id_col, "hot")


def one_hot_totals(df: DataFrame, col: str) -> DataFrame:
    """Rows ``(value, total)``: count per dummy (nulls out)."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("total")))


def status_class(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns(status_class_columns(col, col))


def status_totals(df: DataFrame, col: str) -> DataFrame:
    """Rows ``(status_class, total, pct)``."""
    flagged = status_class(df.select(col), col)
    return _stack_totals(flagged, [f"{col}_{s}" for s, _, _ in STATUS_CLASSES], "status_class")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def select_features(df: DataFrame, roles: dict[str, list[str]] | None = None, rule: str = "source",
                    keep: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Keep the model's numeric features (plus ``keep`` id columns).

    ``rule='source'`` (batch path): drop the time, endpoint and user-agent
    columns found before derivation (``roles``), all non-numeric columns and
    ``time_interval``; derived features survive.
    ``rule='keyword'`` (wizard path): re-apply the keyword lists to the
    current names, so derived ``*_hour``/``*_is_mobile``/``*_endpoint_*``
    columns are dropped too.
    """
    names = df.columns
    if rule == "source":
        if roles is None:
            raise ValueError("rule='source' needs the roles detected before derivation")
        drop = set(roles.get("time", [])) | set(roles.get("endpoint", [])) | set(roles.get("ua", []))
        drop.add("time_interval")
    elif rule == "keyword":
        drop = {n for n in names for r in ("time", "endpoint", "ua")
                if any(w in n.lower() for w in ROLE_KEYWORDS[r])}
    else:
        raise ValueError(f"unknown rule {rule}")
    kept = [n for n in names
            if n in keep or (n not in drop and is_numeric(df.schema[n].dataType))]
    return df.select(*[qcol(n) for n in kept])


def numeric_only(df: DataFrame, keep: tuple[str, ...] = ("log_id",)) -> DataFrame:
    cols = [f.name for f in df.schema.fields if f.name in keep or is_numeric(f.dataType)]
    if not [c for c in cols if c not in keep]:
        raise ValueError("no numeric columns found")
    return df.select(*[qcol(c) for c in cols])


def fill_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """±inf and NaN to NULL, then NULL to 0 (same value type)."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    out = {}
    for c in cols:
        dt = df.schema[c].dataType
        x = qcol(c)
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            x = F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)
        out[c] = F.coalesce(x, F.lit(0).cast(dt))
    return df.withColumns(out)


def parse_params(df: DataFrame, col: str = "parameters") -> DataFrame:
    """JSON text to ``map<string,string>`` plus key count; bad JSON gives NULL map, 0 keys."""
    m = F.from_json(F.col(col), T.MapType(T.StringType(), T.StringType()))
    return (df.withColumn(f"{col}_map", m)
            .withColumn(f"{col}_n_keys", F.coalesce(F.size(F.col(f"{col}_map")), F.lit(0)).cast("int"))
            .withColumn(f"{col}_n_keys", F.when(F.col(f"{col}_n_keys") < 0, 0).otherwise(F.col(f"{col}_n_keys"))))
