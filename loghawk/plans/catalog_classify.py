"""Registered classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loghawk.operators import classify as CL
from loghawk.operators.scaling import train_test
from loghawk.plans.preprocess import zscore_scored
from loghawk.plans.registry import SQL_FEATURES_CTE, finish, register, sql_finish, sql_zscore_ctes, with_log
from loghawk.plans.preprocess import ZSCORE_FEATURES
from loghawk.session import cut_lineage
from loghawk.sources.tables import api_log, read_table

_D = "WITH d AS (SELECT quality AS label, toxic AS prediction FROM labels)"


def _labels(spark, sf):
    """Label = quality, prediction = toxic: two 0/1 columns of the labels table."""
    return read_table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@register("classify_accuracy", sql_finish(_D + " SELECT avg(CAST(label = prediction AS DOUBLE)) AS accuracy FROM d",
                                          doubles=["accuracy"]))
def q_acc(spark, sf):
    return finish(CL.accuracy(_labels(spark, sf)))


@register("classify_confusion", _D + ", cls AS (SELECT label AS c FROM d UNION SELECT prediction FROM d)"
          ", cnt AS (SELECT label, prediction, count(*) AS n FROM d GROUP BY 1, 2)"
          " SELECT a.c AS label, b.c AS prediction, COALESCE(cnt.n, 0) AS count FROM cls a CROSS JOIN cls b"
          " LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c")
def q_confusion(spark, sf):
    return CL.confusion(_labels(spark, sf))


_REPORT_SQL = (
    _D + ", cls AS (SELECT label AS c FROM d UNION SELECT prediction FROM d)"
    ", tp AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,"
    " count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted"
    " FROM cls, d GROUP BY c)"
    ", per AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,"
    " CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM tp)"
    ", per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)"
    " ELSE 0.0 END AS f1 FROM per)"
    ", rep AS (SELECT class, precision, recall, f1, support FROM per2"
    " UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per2"
    " UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),"
    " sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per2)")


@register("classify_report", sql_finish(_REPORT_SQL + " SELECT * FROM rep", doubles=["precision", "recall", "f1"],
                                        others=["class", "support"]))
def q_report(spark, sf):
    return finish(CL.class_report(_labels(spark, sf)))


@register("classify_weighted_f1", sql_finish(_REPORT_SQL + " SELECT f1 AS weighted_f1 FROM rep WHERE class = 'weighted avg'",
                                             doubles=["weighted_f1"]))
def q_wf1(spark, sf):
    return finish(CL.weighted_f1(_labels(spark, sf)))


@register("classify_roc_auc_server_errors", sql_finish(with_log(
    SQL_FEATURES_CTE + sql_zscore_ctes(ZSCORE_FEATURES)
    + ", per AS (SELECT anomaly_score AS s, sum(CASE WHEN status_code >= 500 THEN 1 ELSE 0 END) AS pos,"
    " sum(CASE WHEN status_code >= 500 THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY 1)"
    ", run AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_upto FROM per)"
    " SELECT sum(pos * (neg_upto - neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM run"), doubles=["roc_auc"]))
def q_auc(spark, sf):
    """How well the z-score anomaly score ranks server errors (status >= 500)."""
    scored = zscore_scored(api_log(spark, sf))
    data = scored.select((F.col("status_code") >= 500).cast("int").alias("label"), F.col("anomaly_score").alias("score"))
    return finish(CL.roc_auc(data))


@register("classify_best_epoch", sql_finish(with_log(
    " , h AS (SELECT endpoint AS run_id, CAST(day(request_time) AS INTEGER) AS epoch, avg(response_ms) AS val_metric"
    " FROM api_log GROUP BY 1, 2)"
    ", p AS (SELECT *, max(val_metric) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING"
    " AND 1 PRECEDING) AS prev FROM h)"
    ", i AS (SELECT *, prev IS NULL OR val_metric > prev AS improved FROM p)"
    ", l AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_improved FROM i)"
    " SELECT run_id, max(epoch) FILTER (WHERE improved) AS best_epoch,"
    " arg_max(val_metric, epoch) FILTER (WHERE improved) AS best_value,"
    " min(epoch) FILTER (WHERE epoch - last_improved >= 5) AS stop_epoch FROM l GROUP BY run_id"),
    doubles=["best_value"], others=["run_id", "best_epoch", "stop_epoch"]))
def q_best_epoch(spark, sf):
    """Early stopping on a per-endpoint daily metric (epoch = day of month)."""
    log = api_log(spark, sf)
    h = (log.groupBy(F.col("endpoint").alias("run_id"), F.dayofmonth("request_time").alias("epoch"))
         .agg(F.avg("response_ms").alias("val_metric")))
    return finish(CL.best_epoch(h, "val_metric", patience=5))


def _embeddings(spark, sf):
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("log_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


@register("classify_fit_predict")
def q_fit_predict(spark, sf):
    """Fit the classifier on 80% of the embeddings, predict the rest."""
    train, test = train_test(_embeddings(spark, sf), 0.8, 42, "log_id")
    model = CL.fit_classifier(train, max_iter=100)
    return CL.predict(test, model).select("log_id", "label", "prediction", "probabilities")


@register("classify_elu_head_fit_predict")
def q_elu_head(spark, sf):
    """The reference's classifier head (linear-ELU-dropout-linear-log-softmax,
    NLL, Adam; hidden 64, dropout 0.2, lr 1e-3, 50 epochs) trained with one
    Spark job per epoch on 80% of the embeddings; predictions for the rest."""
    train, test = train_test(_embeddings(spark, sf), 0.8, 42, "log_id")
    model = CL.fit_elu_head(train, hidden=64, lr=1e-3, epochs=50, dropout=0.2)
    return CL.predict_elu_head(test, model).select("log_id", "label", "prediction", "probabilities")


@register("classify_search")
def q_search(spark, sf):
    """20 trials (the reference's library entry point uses 20)."""
    train, valid = train_test(_embeddings(spark, sf), 0.8, 42, "log_id")
    return CL.search(cut_lineage(train, "search-train"), cut_lineage(valid, "search-valid"), n_trials=20, max_iter=50)
