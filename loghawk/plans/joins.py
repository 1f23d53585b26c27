"""Join helpers.

``lookup_join`` joins a (large) fact side to an aggregated lookup side.  It
gives no hint: the planner and AQE pick a broadcast by the lookup's measured
bytes, else a shuffle join whose hot keys (one IP may hold a third of a log)
AQE's skew handling splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(fact: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
                salt_buckets: int = 32, salt_source: str | None = None) -> DataFrame:
    """Shuffle join that spreads every key over ``salt_buckets`` tasks: the
    fact side gets a salt from a hash of ``salt_source`` (a row id; all
    columns when None), the lookup side (one row per key: an aggregate) is
    replicated once per salt value.  A key holding a third of the fact rows
    then lands in ``salt_buckets`` tasks instead of one."""
    src = [F.col(salt_source)] if salt_source else [F.col(c) for c in fact.columns]
    salted_fact = fact.withColumn("__salt", F.pmod(F.xxhash64(*src), F.lit(salt_buckets)).cast("int"))
    salted_lookup = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return salted_fact.join(salted_lookup, list(keys) + ["__salt"], how).drop("__salt")


def lookup_join(fact: DataFrame, lookup: DataFrame, on, how: str = "left",
                salt_buckets: int | None = None, salt_source: str | None = None) -> DataFrame:
    """``fact JOIN lookup``; with ``salt_buckets`` an explicitly salted shuffle
    join (column-name keys only)."""
    if salt_buckets and isinstance(on, (str, list)):
        return salted_join(fact, lookup, [on] if isinstance(on, str) else list(on), how, salt_buckets, salt_source)
    return fact.join(lookup, on, how)
