"""Role detection, required-column check and column mapping (schema metadata only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Role keywords (lower-case substring match on the column name).
ROLE_KEYWORDS = {
    "time": ["time", "date", "timestamp"],
    "ip": ["ip", "address", "src", "source"],
    "ua": ["user", "agent", "browser", "ua"],
    "endpoint": ["endpoint", "api", "url", "path"],
    "status": ["status", "code", "response_code"],
}
# Columns the upload step asks for.
REQUIRED_COLUMNS = ["ip_address", "timestamp", "user_agent", "endpoint", "parameters", "status_code",
                    "response_time"]

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _type_ok(role: str, dt: T.DataType) -> bool:
    if role == "time":
        return isinstance(dt, _TIME_TYPES)
    if role in ("ip", "ua", "endpoint"):
        return isinstance(dt, T.StringType)
    if role == "status":
        return isinstance(dt, _NUMERIC)
    return True


def detect_roles(schema: T.StructType, mode: str = "typed") -> dict[str, list[str]]:
    """Columns per role, in schema order.  ``mode='keyword'`` is the name-only
    rule (a numeric ``response_time_ms`` counts as a time column);
    ``mode='typed'`` also requires a fitting data type."""
    if mode not in ("typed", "keyword"):
        raise ValueError(f"unknown mode {mode}")
    roles: dict[str, list[str]] = {}
    for role, words in ROLE_KEYWORDS.items():
        roles[role] = [f.name for f in schema.fields
                       if any(w in f.name.lower() for w in words)
                       and (mode == "keyword" or _type_ok(role, f.dataType))]
    return roles


def first_role(roles: dict[str, list[str]], role: str) -> str | None:
    cols = roles.get(role) or []
    return cols[0] if cols else None


def missing_columns(schema: T.StructType, required: list[str] = REQUIRED_COLUMNS) -> list[str]:
    """Required names with no column that starts with them (``_`` ignored, case-insensitive)."""
    existing = [n.lower().replace("_", "") for n in schema.fieldNames()]
    return [r for r in required if not any(e.startswith(r.replace("_", "")) for e in existing)]


def required_columns_report(df: DataFrame, required: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Rows ``(required, matched_column, non_null)``: the first column meeting
    the prefix rule (NULL when the name is missing) and how many non-NULL
    values it offers (0 when missing), from one aggregate over the table."""
    def match(r: str) -> str | None:
        key = r.replace("_", "")
        return next((n for n in df.columns if n.lower().replace("_", "").startswith(key)), None)
    found = [(r, match(r)) for r in required]
    cols = sorted({m for _, m in found if m})
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]) if cols else df.agg(F.count(F.lit(1)).alias("__n"))
    rows = ", ".join(f"'{r}', " + (f"'{m}', `{m}`" if m else "CAST(NULL AS STRING), CAST(0 AS BIGINT)")
                     for r, m in found)
    return counts.selectExpr(f"stack({len(found)}, {rows}) AS (required, matched_column, non_null)")


def map_columns(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Add each required name as a copy of the chosen column; originals are kept."""
    cols = {req: F.col(src) for req, src in mapping.items() if src}
    return df.withColumns(cols) if cols else df
