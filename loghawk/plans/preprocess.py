"""End-to-end feature plans: the batch preprocessing path, the staged
("wizard") path, and the z-score outlier plan used as the flagship query.

Each plan is one lazy DataFrame chain: narrow projections, one aggregate
for the request counts (joined back once), one aggregate for the scaler.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.functions.columns import qcol
from loghawk.operators import aggregates as AG
from loghawk.operators import detect as DT
from loghawk.operators import features as FE
from loghawk.operators.scaling import Scaler, apply_scaler, fit_scaler
from loghawk.operators.schema import detect_roles, first_role
from loghawk.session import cut_lineage


#: Window counts that come with the rows (from a stream).
COUNTED = "__counted"


@dataclass
class FeatureSpec:
    """The feature contract kept with a model: names in order, the one-hot
    vocabularies and the roles they were derived from."""
    names: list[str]
    roles: dict[str, list[str]]
    endpoint_vocab: dict[str, list[str]] = field(default_factory=dict)
    rule: str = "source"
    mode: str = "batch"
    scale_onehot: bool = True

    def onehot_names(self) -> set[str]:
        return {f"{c}_endpoint_{v}" for c, values in self.endpoint_vocab.items() for v in values}

    def to_dict(self) -> dict:
        return {"names": self.names, "roles": self.roles, "endpoint_vocab": self.endpoint_vocab,
                "rule": self.rule, "mode": self.mode, "scale_onehot": self.scale_onehot}

    @staticmethod
    def from_dict(d: dict) -> "FeatureSpec":
        return FeatureSpec(list(d["names"]), dict(d["roles"]), dict(d.get("endpoint_vocab", {})),
                           d.get("rule", "source"), d.get("mode", "batch"), bool(d.get("scale_onehot", True)))


def derive_features(df: DataFrame, mode: str = "batch", role_mode: str = "typed", rule: str | None = None,
                    bucket_minutes: int = 5, endpoint_vocab: dict[str, list[str]] | None = None,
                    id_col: str = "log_id", check_ipv4: bool = True, names: list[str] | None = None,
                    carry: str | None = None, stored_counts: tuple[DataFrame, DataFrame] | None = None,
                    dense_onehot: bool = True) -> tuple[DataFrame, FeatureSpec]:
    """Raw log -> numeric features (NULL/NaN/inf filled with 0), unscaled.

    ``mode='batch'``: time parts, IP octets, agent flags, endpoint one-hot,
    status classes, per-IP and per-IP-per-window counts; drop rule 'source'.
    ``mode='wizard'``: the same stages without the window count; drop rule
    'keyword'.  ``mode='window'``: as 'batch' without the per-IP total of the whole
    log, which a stream can't know; a ``COUNTED`` column, if there, is the window count.  Pass ``endpoint_vocab`` from a fitted spec so new data gets
    the same one-hot columns, and its ``names`` so that the octets go by the
    contract and not by what the new data holds.  ``carry`` names a struct
    column that takes the whole log row along.  ``stored_counts``: see
    ``with_request_counts``.  ``dense_onehot=False`` leaves the endpoint one-hots out
    (their sparse form is ``operators.sparse``); nothing is collected then.
    """
    rule = rule or ("keyword" if mode == "wizard" else "source")
    roles = detect_roles(df.schema, role_mode)
    vocab_out: dict[str, list[str]] = {}
    out = df.withColumn(carry, F.struct(*[qcol(c) for c in df.columns if c != COUNTED])) if carry else df
    keep = (id_col, carry) if carry else (id_col,)
    for c in roles["time"]:
        out = FE.time_features(FE.parse_time(out, c), c)
    for c in roles["ip"]:
        # octets only for a column holding a dotted quad somewhere (a probe
        # that stops at the first match, not a full pass)
        wanted = f"{c}_first_octet" in names if names is not None else None
        if dict(out.dtypes)[c] == "string" and (wanted if wanted is not None else not check_ipv4 or FE.any_ipv4(df, c)):
            out = FE.ip_octets(out, c)
    for c in roles["ua"]:
        if dict(out.dtypes)[c] == "string":
            out = FE.ua_flags(out, c)
    for c in roles["endpoint"]:
        if dense_onehot and dict(out.dtypes)[c] == "string":
            given = (endpoint_vocab or {}).get(c)
            out, vocab_out[c] = FE.one_hot(out, c, given)
    for c in roles["status"]:
        if FE.is_numeric(out.schema[c].dataType):
            out = FE.status_class(out, c)
    ip, ts = first_role(roles, "ip"), first_role(roles, "time")
    if mode == "window" and COUNTED in out.columns:
        out = out.withColumnRenamed(COUNTED, "requests_per_ip_5min")
    elif ip and ts and mode == "window":
        out = AG.with_requests_per_ip_window(out, ip, ts, bucket_minutes)
    elif ip and ts and mode == "batch":
        out = AG.with_request_counts(out, ip, ts, bucket_minutes, stored=stored_counts)
    elif ip:
        out = AG.with_requests_per_ip(out, ip)
    out = FE.select_features(out, roles, rule, keep=keep)
    names = [c for c in out.columns if c not in keep]
    out = FE.fill_missing(out, names)
    return out, FeatureSpec(names, roles, vocab_out, rule, mode)


def scale_features(df: DataFrame, spec: FeatureSpec, scaler: Scaler | None = None) -> tuple[DataFrame, Scaler]:
    """Fit (or reuse a stored) z-score scaler and apply it; one-hots stay 0/1
    where the spec says ``scale_onehot=False``."""
    scaler = scaler or fit_scaler(df, [n for n in spec.names if spec.scale_onehot or n not in spec.onehot_names()])
    return apply_scaler(df, scaler), scaler


# Feature contract of the z-score outlier plan (api_log column names).
ZSCORE_FEATURES = [
    "status_code", "response_ms",
    "request_time_hour", "request_time_day", "request_time_dayofweek",
    "ip_address_first_octet", "ip_address_second_octet",
    "user_agent_is_mobile", "user_agent_is_chrome", "user_agent_is_firefox", "user_agent_is_safari",
    "status_code_is_success", "status_code_is_redirect", "status_code_is_client_error",
    "status_code_is_server_error", "requests_per_ip",
]


def zscore_scored(log: DataFrame, features: list[str] = ZSCORE_FEATURES) -> DataFrame:
    """Features -> z-scores -> per-row error = mean of z^2 (the reconstruction
    error of the all-zero reconstruction) -> mean+3*std threshold -> flag and
    score.  Returns log_id, ip_address, request_time, status_code (raw), error, flag, score.

    Scans of the pruned log columns: the per-IP counts (one row an IP, written
    once); one aggregate for the mean and population std of the other
    features; the final projection, which joins the counts, and, where the
    flag is used, the threshold aggregate.  The row-weighted mean and std of
    ``requests_per_ip`` follow exactly from the per-IP counts (each IP's count
    c appears on c rows)."""
    rpi = "requests_per_ip"
    others = [c for c in features if c != rpi]
    f = FE.time_features(log, "request_time")
    f = FE.ip_octets(f, "ip_address")
    f = FE.ua_flags(f, "user_agent")
    f = FE.status_class(f, "status_code")
    f = FE.fill_missing(f.select("log_id", "ip_address", "request_time", F.col("status_code").alias("__status"),
                                 *others), others)
    total = f.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(qcol(c).cast("double")).alias(f"{c}__mean") for c in others],
                  *[F.stddev_pop(qcol(c).cast("double")).alias(f"{c}__std") for c in others]).first()
    n_rows = total["__n"]
    params = {c: (total[f"{c}__mean"], total[f"{c}__std"]) for c in others}
    if rpi in features:
        per_ip = cut_lineage(AG.requests_per_ip(log, "ip_address", rpi), "requests-per-ip")
        m = per_ip.agg(F.sum(F.col(rpi) * F.col(rpi)).alias("s2"), F.sum(rpi).alias("s1")).first()
        mean_r = (m["s2"] or 0) / n_rows if n_rows else None
        dev = per_ip.agg(F.sum(F.col(rpi) * (F.col(rpi) - F.lit(mean_r)) ** 2).alias("d")).first()["d"] or 0.0
        null_rows = n_rows - (m["s1"] or 0)          # rows without an IP have a count of 0
        params[rpi] = (mean_r, ((dev + null_rows * mean_r ** 2) / n_rows) ** 0.5 if n_rows else None)
        f = FE.fill_missing(f.join(per_ip, "ip_address", "left"), [rpi])
    z = apply_scaler(f, Scaler(list(features), params=params))
    err = sum((qcol(c) * qcol(c) for c in features), F.lit(0.0)) / F.lit(float(len(features)))
    scored = z.select("log_id", "ip_address", "request_time", F.col("__status").alias("status_code"),
                      err.alias("reconstruction_error"))
    return DT.flag_and_score(scored, DT.threshold(scored, "reconstruction_error", "std"))


def zscore_top_anomalies(log: DataFrame, k: int = 10) -> DataFrame:
    """Flagship: the k highest-scoring flagged requests."""
    return DT.top_anomalies(zscore_scored(log), k)
