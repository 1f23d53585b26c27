"""Line dedup by a deletion-neighbourhood join (operator 3); DataFrame functions only.

A line goes when an equal line, or one within one edit (a character inserted,
deleted or replaced), stands earlier in the corpus.  Equal lines meet by their
hash.  For the edits, lines emit their deletion variants as hashed keys,
coarse to fine: each line without either half; those that share a key with
another, without each of sixteen blocks; and those that still do, without each
single character of that block.  Two lines are one edit apart exactly if they
agree without the same character (replaced), or if one without a character is
the other (inserted, deleted).  So the earliest partner of a key is an
aggregate and no pairs are built, however many lines share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loghawk.llm.common import store

LINE = ("h1", "h2")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, pos, text) of every line that isn't empty.  ``pos`` orders the
    lines of the corpus: by document id, nulls last, by the text's hash where
    rows share an id, then by line number."""
    text = F.col(f"`{text_col}`").cast("string")
    one = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("hash"), F.posexplode(F.split(text, "\n", -1)).alias("line", "text"))
    pos = F.struct(F.col("doc").isNull().alias("void"), "doc", "hash", "line")
    return one.where("text <> ''").select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), pos.alias("pos"), "text")


def _cut(m: Column, b: Column, blocks: int) -> Column:
    return F.floor(m * b / blocks).cast("int")


def _keys(blocks: int, each) -> Column:
    """Keys (m, b, key) of a line of ``n`` characters without its block b, for
    partners of its own length or one longer (m = n) and one shorter (m = n - 1).
    Blocks are cut for the shorter length m of the two; what is before a block
    is counted from the start, what is behind it from the end."""
    def key(m: Column, b: Column) -> Column:
        before, behind = _cut(m, b, blocks), m - _cut(m, b + 1, blocks)
        rest = F.xxhash64(F.lit(blocks), m, b, F.substring("text", F.lit(1), before), F.when(behind > 0, F.right("text", behind)).otherwise(""))
        return F.struct(m.alias("m"), b.alias("b"), rest.alias("key"))

    return each(lambda b: key(F.col("n"), b), lambda b: key(F.col("n") - 1, b))


def _halves(own, shorter) -> Column:
    """Written out: every line of the corpus goes through these."""
    return F.array(*[f(F.lit(b)) for f in (own, shorter) for b in (0, 1)])


def _blocks(own, shorter) -> Column:
    some = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    return F.concat(F.transform(some, own), F.transform(some, shorter))


BLOCKS = 16


def _shared(lines: DataFrame, keys: Column, name: str) -> DataFrame:
    """(h1, m, b, key) of the lines' keys that a different line has too."""
    keyed = store(lines.select("h1", F.explode(keys).alias("k")).select("h1", "k.*"), f"{name}-keys")
    shared = store(keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a <> z").select("key"), f"{name}-shared")
    return store(keyed.join(shared, "key"), name)


def _without(own: str, i: Column) -> Column:
    return F.concat(F.substring(own, F.lit(1), i), F.substring(F.col(own), i + 2, F.char_length(own)))


def _edited(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines with an earlier line one edit away."""
    lines = lines.withColumn("n", F.char_length("text"))
    half = _shared(lines, _keys(2, _halves), "ld-half").select("h1").distinct()
    some = lines.join(half.hint("merge"), "h1", "left_semi").groupBy(*LINE, "n", "text").agg(F.min("pos").alias("pos"))
    some = store(some, "ld-some")
    near = some.join(_shared(some, _keys(BLOCKS, _blocks), "ld-block"), "h1")
    # the block's own characters; the longer of two lines has one more
    at, size = _cut(F.col("m"), F.col("b"), BLOCKS), _cut(F.col("m"), F.col("b") + 1, BLOCKS) - _cut(F.col("m"), F.col("b"), BLOCKS) + F.col("n") - F.col("m")
    near = near.select(*LINE, "pos", "key", (F.col("n") > F.col("m")).alias("longer"), F.substring("text", at + 1, size).alias("own"))
    places = F.when(F.char_length("own") > 0, F.sequence(F.lit(0), F.char_length("own") - 1)).otherwise(F.array().cast("array<int>"))
    variant = lambda kind, place, own: F.struct(F.lit(kind).alias("kind"), F.xxhash64("key", place, own).alias("key"))
    # kinds: 0 without the character at one place (replaced), 1 without any one character, 2 the whole line
    kinds = F.when(F.col("longer"), F.transform(places, lambda i: variant(1, F.lit(-1), _without("own", i)))).otherwise(
        F.array_append(F.transform(places, lambda i: variant(0, i, _without("own", i))), variant(2, F.lit(-1), F.col("own"))))
    kinds = store(near.select(*LINE, "pos", F.explode(kinds).alias("k")).select(*LINE, "pos", "k.kind", "k.key"), "ld-variants")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("pos", *LINE)))
    firsts = kinds.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("z"), *[least(k).alias(f"f{k}") for k in (0, 1, 2)])
    firsts = store(firsts.where("a <> z and (f0 is not null or f1 is not null and f2 is not null)").select("key", "f0", "f1", "f2"), "ld-firsts")
    other = F.when(F.col("kind") == 0, F.col("f0")).when(F.col("kind") == 1, F.col("f2")).otherwise(F.col("f1"))
    pairs = kinds.join(firsts, "key").withColumn("o", other).where(F.col("o.pos") < F.col("pos")).select(*LINE, F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2")).distinct()
    # exact check of the distance
    texts = some.select(*LINE, "text")
    others = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("text").alias("other"))
    checked = pairs.join(texts, list(LINE)).join(others, ["o1", "o2"]).where(F.levenshtein("text", "other", 1).between(0, 1))
    return store(checked.select(*LINE).distinct(), "ld-edited")


#: Lines that are at least this share of all repeated lines are hot (so there are at most 1 / HOT): their
#: rows are answered by a broadcast, all others by a shuffle.
HOT = 0.001


def _removed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, hash, removed): the numbers of a document's lines that go."""
    lines = _lines(docs, id_col, text_col)
    bare = lines.drop("text")
    repeated = bare.groupBy(*LINE).agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1")
    repeated = store(repeated, "ld-repeated")
    often = HOT * (repeated.agg(F.sum("c")).first()[0] or 0)
    hot = repeated.where(F.col("c") >= often).orderBy(F.desc("c"), *LINE).limit(int(1 / HOT))
    hot = store(hot.drop("c"), "ld-hot")
    # of a hot line only the earliest goes on, so its copies never meet in one task
    first = lines.join(F.broadcast(hot), list(LINE), "left").where("first is null or pos = first").drop("first")
    edited = _edited(first).withColumn("edited", F.lit(True))
    bad = store(repeated.drop("c").join(edited, list(LINE), "full"), "ld-bad")
    known = hot.select(*LINE).join(bad, list(LINE)).select(*LINE, F.struct("first", "edited").alias("hot"))
    marked = bare.join(F.broadcast(known), list(LINE), "left")
    rest = marked.where("hot is null").drop("hot").join(bad.join(F.broadcast(hot.select(*LINE)), list(LINE), "left_anti"), list(LINE))
    gone = marked.where("hot.edited or pos <> hot.first").select("pos").union(rest.where("edited or pos <> first").select("pos"))
    return store(gone.groupBy(F.col("pos.doc").alias("doc"), F.col("pos.hash").alias("hash")).agg(F.collect_set("pos.line").alias("removed")), "ld-removed")


def _kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, text, removed, rest): each row of ``docs`` as a struct, its text, the numbers
    of the lines that go (null: none), and the lines that stay."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    joined = rows.join(_removed(docs, id_col, text_col), F.equal_null(F.col("id"), F.col("doc")) & (F.xxhash64("text") == F.col("hash")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    return joined.select("row", "id", "text", "removed", F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("rest"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256), one row for each input row;
    ``kept_sha256`` is of the lines that stay, joined by a line feed.

    Lines are the text between line feeds; empty lines stay and aren't
    compared.  Lines of a null or empty text: none.  "Earlier" goes by doc_id,
    nulls last, then by line; what removes a line may itself have gone.  Rows
    that share an id are ordered by a hash of their text; equal rows are one
    document and lose the same lines.  Extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    out = _kept(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col)
    return out.select(F.col("id").alias("doc_id"), F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"),
                      F.greatest(F.size(F.coalesce("removed", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("rest", F.lit("")), 256).alias("kept_sha256"))


def documents_without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as text (n_chars, if there, counts
    them).  A row that lost lines and has no other text left goes."""
    out = _kept(docs, id_col, text_col).where(F.col("removed").isNull() | (F.regexp_replace("rest", "\n", "") != ""))
    made = {text_col: F.col("rest"), "n_chars": F.when(F.col("removed").isNull(), F.col("row")["n_chars"]).otherwise(F.char_length("rest").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
