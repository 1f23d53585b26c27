"""Reconstruction error, thresholds, flags, ranking and analyst review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghawk.functions.columns import bucket_start, vector_mse
from loghawk.operators.stats import exact_percentile


def reconstruction_error(df: DataFrame, x: str = "features", xhat: str = "reconstruction",
                         out: str = "reconstruction_error") -> DataFrame:
    """Mean over features of (x - x_hat)^2 per row (array expressions, JVM-side)."""
    return df.withColumn(out, vector_mse(x, xhat))


def mean_loss(df: DataFrame, col: str = "reconstruction_error") -> DataFrame:
    """Row-weighted mean of the per-row error."""
    return df.agg(F.avg(col).alias("mean_loss"))


def threshold(df: DataFrame, col: str = "reconstruction_error", method: str = "std",
              contamination: float = 0.01, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """One-row DataFrame ``threshold``.

    ``std``: mean + 3 x population std (one aggregate).
    ``percentile``: the 100(1-c) percentile with linear interpolation; exact
    by a sketch and a count between its bounds (``exact=True``), or the sketch
    alone, within 1 / ``accuracy`` of the rows.
    """
    spark = df.sparkSession
    if method == "std":
        return df.agg((F.avg(col) + 3 * F.stddev_pop(col)).alias("threshold"))
    if method == "percentile":
        q = 100.0 * (1.0 - contamination)
        if exact:
            v = exact_percentile(df, col, q)
            return spark.createDataFrame([(v,)], "threshold double")
        return df.agg(F.percentile_approx(col, q / 100.0, accuracy).cast("double").alias("threshold"))
    raise ValueError(f"Unsupported threshold method: {method}")


def _t(t) -> Column:
    if isinstance(t, DataFrame):
        return t.select("threshold").scalar()
    if t is None:                      # e.g. the threshold of an empty table
        return F.lit(None).cast("double")
    return t if isinstance(t, Column) else F.lit(float(t))


def flag(df: DataFrame, t, col: str = "reconstruction_error", out: str = "is_anomaly") -> DataFrame:
    """Strictly above the threshold (a float, Column or one-row threshold DataFrame)."""
    return df.withColumn(out, F.col(col) > _t(t))


def score(df: DataFrame, t, col: str = "reconstruction_error", out: str = "anomaly_score") -> DataFrame:
    """error / threshold; the threshold must be > 0 (ANSI division by zero
    fails, so a zero threshold yields NULL scores via try_divide)."""
    return df.withColumn(out, F.try_divide(F.col(col), _t(t)))


def flag_and_score(df: DataFrame, t, col: str = "reconstruction_error") -> DataFrame:
    return score(flag(df, t, col), t, col)


def summary(df: DataFrame, flag_col: str = "is_anomaly") -> DataFrame:
    """One row: total, anomalies, anomaly_pct (NULL on an empty table)."""
    n = F.count(F.lit(1))
    k = F.count_if(F.col(flag_col))
    return df.agg(n.alias("total"), k.alias("anomalies"),
                  F.when(n > 0, k * 100.0 / n).alias("anomaly_pct"))


def anomalies(df: DataFrame, flag_col: str = "is_anomaly", score_col: str = "anomaly_score",
              id_col: str = "log_id") -> DataFrame:
    """Flagged rows, highest score first (ties by id)."""
    return df.where(F.col(flag_col)).orderBy(F.desc(score_col), F.asc(id_col))


def top_anomalies(df: DataFrame, k: int = 10, flag_col: str = "is_anomaly",
                  score_col: str = "anomaly_score", id_col: str = "log_id") -> DataFrame:
    """Top-k of ``anomalies`` (TakeOrdered: each task keeps k rows)."""
    return anomalies(df, flag_col, score_col, id_col).limit(k)


def score_series(df: DataFrame, ts: str, minutes: int = 60, score_col: str = "anomaly_score",
                 flag_col: str = "is_anomaly") -> DataFrame:
    """Per time bucket: rows, flagged rows, max and mean score (chart data that
    stays small however long the log is).  NULL times form no bucket."""
    b = bucket_start(ts, minutes)
    return (df.where(F.col(ts).isNotNull()).groupBy(b.alias("bucket"))
            .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col(flag_col)).alias("anomalies"),
                 F.max(score_col).alias("max_score"), F.avg(score_col).alias("mean_score")))


def select_feedback(df: DataFrame, feedback: DataFrame, id_col: str = "log_id") -> DataFrame:
    """Judged rows with their verdict: inner equi-join on the id (feedback is small
    relative to the log; AQE broadcasts it after measuring it)."""
    return df.join(feedback.select(id_col, "is_true_anomaly"), id_col, "inner")


def suppress(df: DataFrame, feedback: DataFrame, keys: list[str] = ("log_id",)) -> DataFrame:
    """Flags without the known false positives: where the verdict on a row's
    ``keys`` (the request, or e.g. its IP and endpoint) is false, ``is_anomaly`` becomes false and
    ``suppressed`` true.  ``feedback``: (keys.., is_true_anomaly), one row a key; several
    verdicts on a key suppress only if none is true."""
    false = feedback.groupBy(*keys).agg(F.bool_or("is_true_anomaly").alias("__true")).where(~F.col("__true")).withColumn("__false", F.lit(True)).drop("__true")
    known = F.coalesce(F.col("__false"), F.lit(False)) & F.col("is_anomaly")
    marked = df.join(false, list(keys), "left").withColumn("suppressed", F.coalesce(known, F.lit(False))).drop("__false")
    return marked.withColumn("is_anomaly", F.col("is_anomaly") & ~F.col("suppressed")).select(*df.columns, "suppressed")


def feedback_metrics(feedback: DataFrame) -> DataFrame:
    """One row: true/false positives and precision = TP / judged (0 if none)."""
    tp = F.count_if(F.col("is_true_anomaly"))
    n = F.count(F.lit(1))
    return feedback.agg(tp.alias("true_positives"), (n - tp).alias("false_positives"),
                        F.when(n > 0, tp / n).otherwise(F.lit(0.0)).alias("precision"))


def rethreshold(df: DataFrame, new_t: float, col: str = "reconstruction_error") -> DataFrame:
    """Adds ``is_anomaly_new`` and ``anomaly_score_new`` for a new threshold."""
    return (df.withColumn("is_anomaly_new", F.col(col) > F.lit(float(new_t)))
            .withColumn("anomaly_score_new", F.try_divide(F.col(col), F.lit(float(new_t)))))


def rethreshold_summary(df: DataFrame, old_t: float, new_t: float, col: str = "reconstruction_error") -> DataFrame:
    """One row comparing counts and shares under the old and the new threshold."""
    n = F.count(F.lit(1))
    old = F.count_if(F.col(col) > F.lit(float(old_t)))
    new = F.count_if(F.col(col) > F.lit(float(new_t)))
    return df.agg(n.alias("total"), old.alias("anomalies_old"), new.alias("anomalies_new"),
                  F.when(n > 0, old * 100.0 / n).alias("pct_old"),
                  F.when(n > 0, new * 100.0 / n).alias("pct_new"))
