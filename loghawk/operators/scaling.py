"""Z-score scaler, feature vector, repeatable split and sample."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghawk.functions.columns import qcol, z_score


@dataclass
class Scaler:
    """Per-column mean and population std.

    ``stats`` is a lazy one-row aggregate; applying it uses scalar
    subqueries (Catalyst merges them into ONE aggregate job and inlines the
    values), so no row-level join is needed.  ``params`` holds the same
    numbers once collected (for the model artefact / new data)."""
    columns: list[str]
    stats: DataFrame | None = None
    params: dict[str, tuple[float, float]] = field(default_factory=dict)

    def mean(self, c: str) -> Column:
        if c in self.params:
            return F.lit(self.params[c][0])
        return self.stats.select(qcol(f"{c}__mean")).scalar()

    def std(self, c: str) -> Column:
        if c in self.params:
            return F.lit(self.params[c][1])
        return self.stats.select(qcol(f"{c}__std")).scalar()

    def collect(self) -> "Scaler":
        """Materialise the one-row statistics (bounded: 2 numbers per feature)."""
        if not self.params and self.stats is not None:
            row = self.stats.first().asDict()
            self.params = {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in self.columns}
        return self


def fit_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    """Mean and population std of each column in one aggregate (partial + final)."""
    aggs = []
    for c in cols:
        x = qcol(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    return Scaler(list(cols), df.agg(*aggs))


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    """(x - mean) / std per column; std 0 gives 0."""
    return df.withColumns({c: z_score(qcol(c).cast("double"), scaler.mean(c), scaler.std(c))
                           for c in scaler.columns})


def scaler_stats(scaler: Scaler) -> DataFrame:
    """Rows ``(feature, mean, std)`` of a fitted scaler."""
    rows = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in scaler.columns)
    return scaler.stats.selectExpr(f"stack({len(scaler.columns)}, {rows}) AS (feature, mean, std)")


def to_vector(df: DataFrame, names: list[str], out: str = "features", keep: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """Ordered ``array<double>`` of the named features.  A missing name is an
    error (never "the first n columns"); extra columns are ignored."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"features missing from input: {missing}")
    ids = [k for k in keep if k in df.columns]
    return df.select(*ids, F.array(*[qcol(n).cast("double") for n in names]).alias(out))


def _hash_key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def split_cut(fraction: float) -> str:
    """8-hex-digit cut: an MD5 prefix below it falls in the first part."""
    return format(min(int(round(fraction * 16 ** 8)), 16 ** 8 - 1), "08x")


def split(df: DataFrame, fraction: float = 0.8, seed: int = 42, id_col: str = "log_id",
          out: str = "split") -> DataFrame:
    """Tag each row 'train' or 'test' by a hash of (seed, id): repeatable and
    independent of partitioning; sizes are approximate."""
    prefix = F.substring(_hash_key(seed, id_col), 1, 8)
    return df.withColumn(out, F.when(prefix < F.lit(split_cut(fraction)), "train").otherwise("test"))


def train_test(df: DataFrame, fraction: float = 0.8, seed: int = 42, id_col: str = "log_id"):
    tagged = split(df, fraction, seed, id_col, "__split")
    return (tagged.where(F.col("__split") == "train").drop("__split"),
            tagged.where(F.col("__split") == "test").drop("__split"))


def sample_n(df: DataFrame, n: int = 1000, seed: int = 42, id_col: str = "log_id") -> DataFrame:
    """min(n, rows) rows, repeatable: the n smallest hash keys (TakeOrdered,
    each task keeps only its top n; no full sort)."""
    return (df.withColumn("__k", _hash_key(seed, id_col)).orderBy("__k", id_col).limit(n).drop("__k"))
