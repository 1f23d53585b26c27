"""Mixing sources to target weights (operator 7).

Each row gets a hash-random key.  The key's first digits are a range partition
of its source (the key is uniform, so the ranges are even, and a source with a
third of all rows spreads over as many tasks as its share).  A source's prefix
sums of sizes are the sums of the ranges before, plus a running sum within the
range; each source is cut at its exact budget, after as many whole epochs as
its target holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.common import WORD, store

#: Rows of a range of a source, about.
RANGE_ROWS = 5_000
MAX_EPOCHS = 3


def words(text):
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size, rows, target), one row a source.

    Sources in code-point order, null last, get the weights in turn.  The
    targets share the sum of all sizes by weight; none exceeds max_epochs
    times its source's size, and what is above goes to the others by weight
    until none is above: target = least(most, level * weight) for the one
    level that spends the sum.  Only one row a source goes through one task.
    """
    per = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    turn = (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
    per = per.withColumn("most", (F.col("source_size") * max_epochs).cast("double"))
    # in the order in which a rising level fills them; before a source: what full ones take, and the weight left
    order = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(order))
    # the first source that its level doesn't fill fixes the level
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))).over(every)
    return per.withColumn("level", first["level"]).select("skey", "source_size", "rows", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more) -> DataFrame:
    text, source, doc_id = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    tie = F.xxhash64(text)
    return docs.select(doc_id.alias("doc_id"), F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("skey"), words(text).alias("size"),
                       F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), tie)))).alias("key"), tie.alias("tie"), *more)


def _taken(sized: DataFrame, goal: DataFrame, max_epochs: int) -> DataFrame:
    """``sized`` with source_size, target, taken."""
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.ceil(F.col("rows") / RANGE_ROWS)).cast("long")
    placed = sized.join(goal, "skey").withColumn("range", place)
    lower = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
    sums = store(sums.select("skey", "range", F.coalesce(F.sum("range_size").over(lower), F.lit(0)).alias("base")), "mix-ranges")
    within = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["skey", "range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - F.col("base") - F.col("own")))
    return run.withColumn("taken", (epochs * F.col("size") + part).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (1, 2, 3), seed: int = 7, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each input row.

    ``size``: words of the text, null 0.  ``taken``: words that the mix takes
    of the row, with repeats; each source's sum is its target, rounded to a
    whole word, and the row at the cut gives its first words only.  A null
    source is a source of its own, the last.  Rows that repeat an id, or
    have none, are ordered by a digest of the text; equal rows may change
    places, with the same rows returned.  Without words every target is 0.
    The same rows and seed give the same mix, however they are partitioned.
    Extra columns are ignored.
    """
    sized = store(_sized(docs, id_col, text_col, source_col, seed), "mix-sized")
    goal = store(targets(sized, weights, max_epochs), "mix-targets")
    return _taken(sized, goal, max_epochs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: Sequence[float] = (1, 2, 3), seed: int = 7, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed rows with the columns of ``docs``: a row is repeated for each
    whole time that it is taken, and the row at a source's cut comes once
    more with its first words only, joined by one space (n_chars, if there,
    then counts these).  Rows of which nothing is taken go, also those
    without words."""
    sized = _sized(docs, id_col, text_col, source_col, seed)
    goal = store(targets(store(sized.select("skey", "size"), "mix-sized"), weights, max_epochs), "mix-targets")
    sized = _sized(docs, id_col, text_col, source_col, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mix = _taken(sized, goal, max_epochs).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    mix = mix.select("row", "size", F.explode(F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")),
                                                         lambda i: F.when(i <= whole, F.col("size")).otherwise(rest))).alias("words"))
    cut = F.col("words") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text_col], F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("row")[text_col])
    mix = mix.withColumn("words_text", text)
    made = {text_col: F.col("words_text"), "n_chars": F.when(cut, F.char_length("words_text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return mix.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def oracle() -> str:
    return r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('7:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
p AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY skey) - 1) % 3 AS DOUBLE) AS weight FROM d GROUP BY skey),
o AS (SELECT *, 3.0 * source_size AS most, row_number() OVER (ORDER BY 3.0 * source_size / weight, skey) AS place FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT level AS fixed FROM l WHERE level * weight <= most ORDER BY place LIMIT 1),
t AS (SELECT skey, source_size, CAST(least(most, fixed * weight) AS DOUBLE) AS target FROM l, f),
r AS (SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken FROM r"""
