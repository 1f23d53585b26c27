"""Property tests (hypothesis) against numpy on small random inputs."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loghawk.operators import profile as PR
from loghawk.operators.scaling import apply_scaler, fit_scaler
from loghawk.operators.stats import exact_percentile

_vals = st.lists(st.floats(min_value=-1e3, max_value=1e3, allow_nan=False, allow_infinity=False, width=32),
                 min_size=1, max_size=60)
_cfg = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@_cfg
@given(_vals, st.integers(min_value=1, max_value=12))
def test_histogram_matches_numpy(spark, vals, bins):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r["count"] for r in PR.histogram(df, "x", bins).orderBy("bin").collect()]
    lo, hi = min(vals), max(vals)
    exp, _ = np.histogram(vals, bins=bins, range=(lo, hi)) if hi > lo else (np.array([len(vals)]), None)
    assert sum(got) == len(vals)
    if hi > lo:
        # equal except values within float noise of an inner edge
        assert np.abs(np.array(got) - exp).sum() <= 2 * sum(
            1 for v in vals for k in range(1, bins) if abs(v - (lo + k * (hi - lo) / bins)) < 1e-9 * max(1, abs(v)))


@_cfg
@given(_vals, st.floats(min_value=0, max_value=100))
def test_percentile_matches_numpy(spark, vals, q):
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    assert abs(exact_percentile(df, "x", q) - np.percentile(np.array(vals, dtype=float), q)) <= 1e-9 * (1 + max(map(abs, vals)))


@_cfg
@given(_vals)
def test_scaler_matches_numpy(spark, vals):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "log_id long, x double")
    got = [r.x for r in apply_scaler(df, fit_scaler(df, ["x"])).orderBy("log_id").collect()]
    a = np.array(vals, dtype=float)
    sd = a.std()
    exp = np.zeros_like(a) if sd == 0 else (a - a.mean()) / sd
    assert np.allclose(got, exp, atol=1e-6)
