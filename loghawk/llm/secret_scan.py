"""Secret scan with corpus-wide ownership frequency (operator 1); DataFrame functions only.

Spans of the base kinds (``assign``, ``access``, ``hex``) come from patterns.
A further kind, ``token``, takes random-looking words that no base span
covers; whether one is a credential is decided by who holds it: candidate hashes
are counted by distinct owners and repositories over the whole corpus, and a
value that only a few owners hold is live-looking, while one that is copied
widely is an example (a documentation key, a licence id, a test vector).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.common import store

#: Base kinds in order: pattern, group that holds the secret, least length of it.  Fixed values.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),       # runs are maximal, so shorter ones need not be matched to be dropped
)
#: Words of 20 and more characters with a digit, a capital and a small letter.
TOKEN = ("token", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+", 0, 20)
NAMES = tuple(k[0] for k in KINDS)


def matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """A pattern's matches, leftmost and non-overlapping: array of (kind, i,
    gap, len, good, proof).  ``gap`` is the number of code points between the
    last match and this one: the pieces between the matches and the matches
    in turn make up the text.  Not good: the group is shorter than ``least``."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), whole.alias("whole"), value.alias("value"))
    # the last piece has no match behind it
    out = F.transform(F.filter(rows, lambda r: r["whole"].isNotNull()), lambda r, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("long").alias("i"), F.char_length(r["piece"]).cast("long").alias("gap"), F.char_length(r["whole"]).cast("long").alias("len"),
        (F.char_length(r["value"]) >= least).alias("good"), F.unhex(F.sha2(r["value"], 256)).alias("proof")))
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(F.array().cast("array<struct<kind:string,i:long,gap:long,len:long,good:boolean,proof:binary>>"))


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, owner, repository) and their candidate spans (row, owner, repository, kind, start, end, proof)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(part(owner_col)).alias("owner"),
                       F.xxhash64(*[part(c) for c in repository_cols]).alias("repository"), F.concat(*[matches(text, *k) for k in (*KINDS, TOKEN)]).alias("found"))
    rows = store(rows, "se-rows")
    one = rows.select("row", "owner", "repository", F.explode("found").alias("m")).select("row", "owner", "repository", "m.*")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "kind").orderBy("i"))
    spans = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("good")
    # a token that a base span overlaps is dropped: one that begins no later and ends behind its start, or begins inside it
    base = F.col("kind") != TOKEN[0]
    order = Window.partitionBy("row").orderBy("start", base.desc())
    ends = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.withColumn("ends", ends).withColumn("starts", starts).where(base | ~(F.coalesce(F.col("ends") > F.col("start"), F.lit(False)) | F.coalesce(F.col("starts") < F.col("end"), F.lit(False))))
    return rows.drop("found"), store(spans.select("row", "owner", "repository", "kind", "start", "end", "proof"), "se-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """(proof, owners, repositories, copies): distinct holders of each candidate
    value.  Counted by owner and repository first, so that a value that very
    many rows hold is one row for each task and holder."""
    held = spans.groupBy("proof", "owner", "repository").agg(F.count("*").alias("copies"))
    return held.groupBy("proof").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.sum("copies").alias("copies"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repository_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 2, max_repositories: int = 4) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example), one row for each input row.

    ``spans``: kind:start:end of all spans by start, then kind as listed,
    joined by commas; ``base_sha256`` is the digest of the base kinds' alone.
    A value is live-looking when at most ``max_owners`` owners and
    ``max_repositories`` repositories hold it; only then is a ``token`` a span.
    ``n_live`` and ``n_example`` count the row's candidates of all kinds on
    either side.  ``owner_col`` names the owner, ``repository_cols`` together
    the repository; a null is an owner of its own.  Null and empty texts have
    no span.  Rows that repeat, or have no id, are answered each for itself.
    Extra columns are ignored.
    """
    rows, spans = candidates(docs, id_col, text_col, owner_col, repository_cols)
    owned = store(ownership(spans).select("proof", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live")), "se-owned")
    judged = spans.join(owned, "proof")
    order = F.array_position(F.array(*[F.lit(x) for x in (*NAMES, TOKEN[0])]), F.col("kind"))
    entry = F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "end").alias("name"))
    base = F.col("kind") != TOKEN[0]
    per = judged.groupBy("row").agg(
        *[F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in NAMES],
        F.sort_array(F.collect_list(F.when(base, entry))).alias("base"), F.sort_array(F.collect_list(F.when(base | F.col("live"), entry))).alias("every"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    out = rows.join(per, "row", "left")
    joined = lambda c: F.coalesce(F.array_join(F.col(c)["name"], ","), F.lit(""))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", count("n_assign"), count("n_access"), count("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"),
                      joined("every").alias("spans"), count("n_live"), count("n_example"))
