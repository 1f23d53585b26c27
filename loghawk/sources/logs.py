"""Log scan (CSV/Parquet/JSON) and the three sinks: mapped log, report, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schema of a raw access log as written by the sample generator.
RAW_LOG_SCHEMA = T.StructType([
    T.StructField("ip_address", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("parameters", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("response_time_ms", T.LongType()),
])

# Quotes within a quoted value are doubled, not escaped by a backslash.
RFC_4180 = {"header": True, "quote": '"', "escape": '"'}


def read_logs(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              fmt: str = "csv", corrupt_column: str = "_corrupt_record", with_id: str | None = None,
              multi_line: bool = False) -> DataFrame:
    """Scan a log.  CSV as in RFC 4180: header row, a quote within a quoted
    value is doubled, and, with ``multi_line`` (files are then not split), a
    quoted value may hold line breaks.  Malformed lines land in
    ``_corrupt_record`` instead of failing the job, whether the schema is a
    StructType, a DDL string or inferred (one extra pass; give a schema in
    production).
    ``with_id`` names a row-id column to add (``monotonically_increasing_id``:
    unique, and stable while the files and split size stay the same; write
    the table once to pin it for later joins with feedback)."""
    df = _read(spark, path, schema, fmt, corrupt_column, multi_line)
    return df.withColumn(with_id, F.monotonically_increasing_id()) if with_id else df


def _read(spark: SparkSession, path: str, schema, fmt: str, corrupt_column: str, multi_line: bool) -> DataFrame:
    if fmt == "csv":
        reader = spark.read.options(**RFC_4180).option("mode", "PERMISSIVE").option("multiLine", multi_line)
        if schema is None:
            schema = reader.option("inferSchema", True).csv(path).schema
        elif isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        if corrupt_column not in schema.fieldNames():
            schema = T.StructType(schema.fields + [T.StructField(corrupt_column, T.StringType())])
        return reader.schema(schema).option("columnNameOfCorruptRecord", corrupt_column).csv(path)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_logs(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None) -> None:
    """Write a (mapped) log.  Parquet by default; ``partition_by`` e.g. a date
    column lets later reads prune partitions."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**RFC_4180)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scored rows as CSV with a header (one file per task; no funnel through one writer)."""
    df.write.mode(mode).options(**RFC_4180).csv(path)


def write_feedback(df: DataFrame, path: str, mode: str = "append", batch_id: int | None = None) -> None:
    """Write reviewer verdicts ``(log_id, is_true_anomaly)``.  With ``batch_id`` (0, 1,
    .. in the order of the reviews) a batch is a folder of its own: writing it again
    puts the same rows there, so a retry changes nothing; see ``read_feedback``.
    Without one, rows are appended."""
    rows = df.select("log_id", "is_true_anomaly")
    if batch_id is None:
        rows.write.mode(mode).parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """``(log_id, is_true_anomaly)``: the last batch's verdict of each id; of several
    in that batch, "true" wins.  Verdicts without an id are left out."""
    schema = "log_id long, is_true_anomaly boolean, batch_id long"
    verdicts = spark.read.schema(schema).parquet(path).where(F.col("log_id").isNotNull() & F.col("is_true_anomaly").isNotNull())
    return verdicts.groupBy("log_id").agg(F.max(F.struct("batch_id", "is_true_anomaly"))["is_true_anomaly"].alias("is_true_anomaly"))
