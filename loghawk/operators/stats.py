"""Exact order statistics without collecting a column.

``percentile`` (exact) keeps every distinct value of a group in one
aggregation buffer; on a whole log that is one unbounded task.  Here a
mergeable quantile sketch (``approx_percentile``, whose rank error is at most
1 / ``ACCURACY`` of the rows) gives bounds around a wanted rank, and one counting pass
between them finds it exactly.  Where more than ``MOST`` values may lie between
the bounds (some hundred million rows on), the sketch is taken again of those first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.session import cut_lineage

#: Rank error of the sketch: rows / ACCURACY.
ACCURACY = 20_000
#: Different values between the bounds that a counting pass may return.
MOST = 100_000


def kth_smallest(df: DataFrame, col: str, ks: list[int], bins: int = ACCURACY, most: int = MOST) -> dict[int, float]:
    """Exact 0-based order statistics of a numeric column; NULL and NaN don't
    count, infinite values do.  One count, then two passes for ranks that lie
    together.  ``bins``: the sketch's resolution (rank error rows / bins)."""
    vals = _values(df, col)
    total = vals.count()
    want = sorted(set(ks))
    if want and not (0 <= want[0] and want[-1] < total):
        raise IndexError(f"ranks {want[0]}..{want[-1]} outside 0..{total - 1}")
    out: dict[int, float] = {}
    while want:
        near = [k for k in want if k - want[0] <= total // bins + 1]
        out.update(_ranks(vals, total, near, bins, most))
        want = want[len(near):]
    return out


def _values(df: DataFrame, col: str) -> DataFrame:
    """The column's values, written once; -0.0 is 0.0."""
    return cut_lineage(df.select((F.col(col).cast("double") + 0.0).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")), "order-stats")


def _sketch(vals: DataFrame, low: float, high: float, accuracy: int):
    """(rows, bounds around the shares low..high)."""
    shares = [min(max(p, 0.0), 1.0) for p in (low - 3 / accuracy, high + 3 / accuracy)]
    r = vals.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", shares, accuracy).alias("b")).first()
    return r["n"], r["b"]


def _ranks(vals: DataFrame, total: int, ks: list[int], accuracy: int, most: int, bounds=None) -> dict[int, float]:
    """Exact values at neighbouring ranks, by bounds and a count between them."""
    lo, hi = bounds or _sketch(vals, ks[0] / total, (ks[-1] + 1) / total, accuracy)[1]
    # the ends may be frequent; strictly between them lie few
    if 10 * total / accuracy + 2 <= most:
        place = F.when(F.col("v") < lo, F.lit(None)).otherwise(F.col("v"))
        rows = vals.where(F.col("v") <= hi).groupBy(place.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.asc_nulls_first("v")).collect()
        out, seen = {}, 0
        for r in rows:
            if r["v"] is not None:
                out.update({k: float(r["v"]) for k in ks if seen <= k < seen + r["n"]})
            seen += r["n"]
        if len(out) < len(ks):      # not possible within the sketch's error
            raise ArithmeticError(f"ranks {ks} are outside the sketch's bounds {lo}..{hi}")
        return out
    c = vals.agg(F.count_if(F.col("v") < lo).alias("below"), F.count_if(F.col("v") == lo).alias("lo"), F.count_if((F.col("v") > lo) & (F.col("v") < hi)).alias("mid"),
                   F.count_if(F.col("v") == hi).alias("hi")).first()
    start = c["below"]
    if ks[0] < start or ks[-1] >= start + c["lo"] + c["mid"] + (c["hi"] if lo < hi else 0):
        raise ArithmeticError(f"ranks {ks} are outside the sketch's bounds {lo}..{hi}")
    out = {k: float(lo) for k in ks if k < start + c["lo"]} | ({} if lo == hi else {k: float(hi) for k in ks if k >= start + c["lo"] + c["mid"]})
    ks = [k for k in ks if k not in out]
    if not ks:
        return out
    before = start + c["lo"]
    found = _ranks(vals.where((F.col("v") > lo) & (F.col("v") < hi)), c["mid"], [k - before for k in ks], accuracy, most)
    return out | {k + before: v for k, v in found.items()}


def exact_percentile(df: DataFrame, col: str, q: float, accuracy: int = ACCURACY, most: int = MOST) -> float | None:
    """Linear-interpolation percentile (numpy default), ``q`` in [0, 100]: two
    passes over the written values."""
    vals = _values(df, col)
    n, bounds = _sketch(vals, q / 100, q / 100, accuracy)
    if n == 0:
        return None
    pos = q / 100.0 * (n - 1)
    lo_i = int(math.floor(pos))
    hi_i = min(lo_i + 1, n - 1)
    if n <= accuracy:       # shares this close to each other are ranks apart
        bounds = None
    got = _ranks(vals, n, sorted({lo_i, hi_i}), accuracy, most, bounds)
    a, b = got[lo_i], got[hi_i]
    return a if a == b else a + (b - a) * (pos - lo_i)


def approx_percentile(df: DataFrame, col: str, q: float, accuracy: int = ACCURACY) -> float | None:
    """A value whose rank is within 1 / ``accuracy`` of the rows of ``q`` (in [0, 100]):
    one pass, one mergeable sketch."""
    x = F.col(col).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).agg(F.percentile_approx(x, q / 100, accuracy)).first()[0]
