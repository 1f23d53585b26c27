"""Exact dedup by a heavy-hitter split (operator 10); DataFrame functions only.

The counters of a Misra-Gries pass (``freqItems``) name every digest that may
hold at least a share ``support`` of the rows, at most 1 / support of them.  An
exact count verifies them; the winners, few by proof, are broadcast and their
rows answered on the map side, without a shuffle.  All other digests are rare
by then and use ordinary shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loghawk.llm.common import GAP, store


def normalised(text_col: str):
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), GAP, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each input row.

    Texts are equal when their SHA-256 after normalisation is.  The row with
    the smallest doc_id stays; rows with a null id never stay beside one
    with an id (alone among themselves keep_id is null and they are kept).
    Rows that repeat the staying id are all kept: the id decides.  At most
    1 / support digests are broadcast.  Extra columns are ignored.
    """
    hashed = store(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(normalised(text_col), 256).alias("text_sha256")), "ed-digests")
    row = hashed.stat.freqItems(["text_sha256"], support).first()
    often = list(row[0] or []) if row else []
    agg = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    frequent = F.col("text_sha256").isin(often) if often else F.lit(False)
    n = hashed.count()
    winners = hashed.where(frequent).groupBy("text_sha256").agg(*agg).where(F.col("group_size") >= support * n)
    won = winners.collect()     # at most 1 / support rows
    out = ["doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"]
    heavy = F.col("text_sha256").isin([r[0] for r in won]) if won else F.lit(False)
    rest = hashed.where(~heavy)
    groups = store(rest.groupBy("text_sha256").agg(*agg), "ed-groups")
    light = rest.join(groups, "text_sha256").select(*out)
    if not won:
        return light
    spark = docs.sparkSession
    table = spark.createDataFrame([tuple(r) for r in won], winners.schema)
    return hashed.where(heavy).join(F.broadcast(table), "text_sha256").select(*out).union(light)


def oracle(documents: str = "documents") -> str:
    return rf"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM {documents}),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, text_sha256 FROM h JOIN g USING (text_sha256)"""
