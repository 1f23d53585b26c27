"""Reusable Spark ``Column`` expressions.

Nothing here touches data; each function returns an expression that
Catalyst folds into the surrounding projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "IPV4_PATTERN", "OCTET_PATTERNS", "UA_FLAG_PATTERNS", "STATUS_CLASSES",
    "time_part_columns", "bucket_start", "ip_octet", "ua_flag", "status_class_columns",
    "round6", "vector_mse", "z_score", "col_or_lit", "qcol", "ZERO_SCALE",
]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# IPv4 test and octet extraction (unanchored, first match):
IPV4_PATTERN = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
OCTET_PATTERNS = {
    "first_octet": r"(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "second_octet": r"\d{1,3}\.(\d{1,3})\.\d{1,3}\.\d{1,3}",
}
# User-agent flags, case-insensitive substring patterns (not exclusive):
UA_FLAG_PATTERNS = {
    "is_mobile": "Mobile|Android|iOS",
    "is_chrome": "Chrome",
    "is_firefox": "Firefox",
    "is_safari": "Safari",
}
# Status classes: (suffix, lower bound inclusive, upper bound exclusive or None):
STATUS_CLASSES = [
    ("is_success", 200, 300),
    ("is_redirect", 300, 400),
    ("is_client_error", 400, 500),
    ("is_server_error", 500, None),
]
# ---------------------------------------------------------------------------


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def qcol(name: str) -> Column:
    """A column by its exact name: dots or slashes inside a derived name (a
    one-hot column of ``/api/v1.0``) are not read as struct-field access."""
    return F.col("`" + name.replace("`", "``") + "`")


def time_part_columns(ts: str | Column, prefix: str) -> dict[str, Column]:
    """``{prefix}_hour``, ``{prefix}_day``, ``{prefix}_dayofweek`` (Monday = 0)."""
    c = col_or_lit(ts)
    return {
        f"{prefix}_hour": F.hour(c),
        f"{prefix}_day": F.dayofmonth(c),
        f"{prefix}_dayofweek": F.weekday(c),
    }


def bucket_start(ts: str | Column, minutes: int = 5, ntz: bool = True) -> Column:
    """Floor a timestamp to ``minutes`` (a divisor of 60); NULL stays NULL.

    Unlike ``F.window`` this is a plain projection, so rows with a NULL time
    are kept (the pandas ``dt.floor`` behaviour).
    """
    if 60 % minutes:
        raise ValueError("minutes must divide 60")
    c = col_or_lit(ts)
    start = F.date_trunc("hour", c) + F.make_dt_interval(
        F.lit(0), F.lit(0), (F.floor(F.minute(c) / minutes) * minutes).cast("int"), F.lit(0))
    return start.cast(T.TimestampNTZType() if ntz else T.TimestampType())


def ip_octet(ip: str | Column, which: str) -> Column:
    """Octet as double; NULL when the value holds no dotted quad (no range check)."""
    raw = F.regexp_extract(col_or_lit(ip), OCTET_PATTERNS[which], 1)
    return F.nullif(raw, F.lit("")).try_cast("double")


def ua_flag(ua: str | Column, flag: str) -> Column:
    """0/1 flag; a NULL agent gives 0."""
    pat = "(?i)" + UA_FLAG_PATTERNS[flag]
    return F.coalesce(col_or_lit(ua).rlike(pat).cast("int"), F.lit(0))


def status_class_columns(status: str | Column, prefix: str) -> dict[str, Column]:
    c = col_or_lit(status)
    out = {}
    for suffix, lo, hi in STATUS_CLASSES:
        cond = c >= lo if hi is None else (c >= lo) & (c < hi)
        out[f"{prefix}_{suffix}"] = F.coalesce(cond.cast("int"), F.lit(0))
    return out


# A scale below 10 x double epsilon counts as zero (float noise of a constant column).
ZERO_SCALE = 10 * 2.220446049250313e-16


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std with a zero (or NULL, or float-noise) std giving 0."""
    return F.when((std.isNull()) | (std <= F.lit(ZERO_SCALE)), F.lit(0.0)).otherwise((x - mean) / std)


def vector_mse(x: str | Column, y: str | Column) -> Column:
    """Mean over positions of (x - y)^2 for two equal-length arrays."""
    diff2 = F.zip_with(col_or_lit(x), col_or_lit(y), lambda a, b: (a - b) * (a - b))
    return F.aggregate(diff2, F.lit(0.0), lambda acc, v: acc + v) / F.size(col_or_lit(x))


def round6(c: str | Column) -> Column:
    return F.round(col_or_lit(c), 6)
