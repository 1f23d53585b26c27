"""Benchmark decontamination by a positional inverted index (operator 13);
DataFrame functions only.

The index is one written table of postings (term, document, position) of the
training texts, for the terms that the test phrases use.  A phrase is looked up
from its rarest term on: the postings of that term, each less the term's offset
in the phrase, are the places where the phrase may start; they are intersected
with the offset-adjusted postings of the next rarest term, and then with those
of all other terms.  What is left of a phrase's starts are its exact matches.

Rarest terms have short lists, so a frequent word is never the key of the
first join, and later joins are keyed by document and position, which no frequent
word or passage makes hot.  The postings are read with the few terms asked for;
which side of a join is broadcast is Spark's choice by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loghawk.llm.common import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word once A-Z are lower-cased: digits, a-z and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window.
WIDTH = 10
#: Stands for a null document id in the index; rows are told apart by their text's hash as well.
NO_ID = -(2**63)

KEY = ["doc", "copy"]


def terms(text_col: str):
    """The words of a text, A-Z in lower case; null has none.  (``lower`` would
    change other letters too, so it serves texts of ASCII only.)"""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, GAP), "")      # empty before a first gap and behind a last one


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Equal keys have equal texts, so rows that repeat an id do no harm."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), key.alias("doc"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("copy"),
                       terms(text_col).alias("words"))


def token_index(docs: DataFrame, vocabulary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (doc, copy, pos, term) of the texts, written to the shared
    folder; with ``vocabulary`` (term) of its terms only."""
    tokens = _keyed(docs, id_col, text_col).select(*KEY, F.posexplode("words").alias("pos", "term"))
    if vocabulary is not None:
        tokens = tokens.join(vocabulary, "term", "left_semi").select(*KEY, "pos", "term")
    return store(tokens, "dc-index")


def windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase): each item's windows of ``width`` consecutive words, as
    arrays; an item of fewer words, but not none, is one window."""
    item = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), terms(text_col).alias("w")).where(F.size("w") > 0)
    first = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return item.select("item", "w", F.explode(first).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(width)).alias("phrase"))


def _rarest_first(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, n, lists): the terms of a phrase as (count, off, term), the
    rarest first; phrases with a term that the index doesn't have are out."""
    counts = store(index.groupBy("term").agg(F.count("*").alias("c")), "dc-counts")
    asked = phrases.select("phrase_id", F.size("phrase").alias("n"), F.posexplode("phrase").alias("off", "term"))
    lists = asked.join(counts, "term").groupBy("phrase_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "off", "term"))).alias("lists"))
    return store(lists.where(F.size("lists") == F.col("n")), "dc-lists")


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase_id, doc, copy, start, n): all places where a phrase stands.
    ``phrases``: (phrase_id, phrase), the phrase an array of one or more terms."""
    lists = _rarest_first(index, phrases)
    # small tables are stored: their size is known when the joins are planned
    nth = [store(lists.where(F.col("n") > r).select("phrase_id", "n", F.col("lists")[r]["term"].alias("term"), F.col("lists")[r]["off"].alias("off")), "dc-nth") for r in (0, 1)]
    at = ["phrase_id", *KEY, "start", "n"]
    # the rarest term's postings, less its offset
    starts = index.join(nth[0], "term").select("phrase_id", *KEY, (F.col("pos") - F.col("off")).alias("start"), "n").where("start >= 0")
    whole = starts.where("n = 1")
    # intersected with the next rarest's; only postings of such terms are read
    second = index.join(store(nth[1].select("term").distinct(), "dc-second"), "term", "left_semi")
    asked = starts.join(nth[1].drop("n"), "phrase_id").withColumn("pos", F.col("start") + F.col("off")).drop("off")
    starts = store(asked.join(second, [*KEY, "pos", "term"]).select(*at), "dc-starts")
    # and with those of all other terms, in the documents that are left
    several = starts.where("n > 2")
    rest = several.join(lists.select("phrase_id", F.slice("lists", F.lit(3), F.greatest(F.size("lists"), F.lit(1))).alias("lists")), "phrase_id")
    rest = rest.select(*at, F.explode("lists").alias("l")).select(*at, (F.col("start") + F.col("l.off")).alias("pos"), F.col("l.term").alias("term"))
    near = index.join(store(several.select(*KEY).distinct(), "dc-near"), KEY, "left_semi")
    full = rest.join(near, [*KEY, "pos", "term"]).groupBy(*at).agg(F.count_distinct("pos").alias("found")).where(F.col("found") == F.col("n") - 2)
    return whole.unionByName(starts.where("n = 2")).unionByName(full.drop("found")).select(*at).distinct()


def proximity_matches(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """(phrase_id, doc, copy, at): places of a phrase's rarest term where all its
    different terms stand within ``span`` consecutive words, in any order.

    The other terms' postings meet the rarest term's by document and block of
    ``span`` positions, so a place meets at most three blocks of each list.
    """
    lists = _rarest_first(index, phrases)
    each = lists.select("phrase_id", F.explode("lists").alias("l")).select("phrase_id", F.col("l.c").alias("c"), F.col("l.term").alias("term")).distinct()
    turn = Window.partitionBy("phrase_id").orderBy("c", "term")
    each = each.select("phrase_id", "term", F.row_number().over(turn).alias("r"), F.count("*").over(Window.partitionBy("phrase_id")).alias("k"))
    posted = index.join(each, "term")
    block = F.floor(F.col("pos") / span)
    key = ["phrase_id", *KEY, "block"]
    anchor = posted.where("r = 1").select("phrase_id", *KEY, "k", F.col("pos").alias("at"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    other = posted.select("phrase_id", *KEY, block.alias("block"), "pos", "r")
    met = anchor.join(other, key).where(F.abs(F.col("pos") - F.col("at")) < span)
    found = met.groupBy("phrase_id", *KEY, "at", "k").agg(F.collect_set(F.struct("pos", "r")).alias("near"))

    def covered(first):
        inside = F.filter("near", lambda x: (x["pos"] >= first["pos"]) & (x["pos"] < first["pos"] + span))
        return (first["pos"] <= F.col("at")) & (first["pos"] > F.col("at") - span) & (F.size(F.array_distinct(F.transform(inside, lambda x: x["r"]))) == F.col("k"))

    return found.where(F.exists("near", covered)).select("phrase_id", *KEY, "at")


def covered_words(spans):
    """Words in a union of spans (start, end), given sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach"))

    def add(acc, s):
        new = F.greatest(s["end"] - F.greatest(s["start"], acc["reach"]), F.lit(0))
        return F.struct((acc["hit"] + new).alias("hit"), F.greatest(acc["reach"], s["end"]).alias("reach"))

    return F.aggregate(spans, zero, add)["hit"]


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for
    each input row: the words inside any occurrence of an item's window.

    Null texts, and texts without words, have no words and no hits; items
    without words have no window.  Items that repeat an id are one item with the
    windows of all; a null item id takes part and is written as an empty string.
    Rows that repeat a document id are judged by their own text; a null id stays
    null.  Extra columns are ignored.  A document's matches are held in one
    row: at most one span for each of its words and each window length.
    """
    win = store(windows(items, width), "dc-windows")
    phrases = store(win.select("phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "dc-phrases")
    vocabulary = store(phrases.select(F.explode("phrase").alias("term")).distinct(), "dc-vocabulary")
    index = token_index(docs, vocabulary, id_col, text_col)
    found = store(phrase_matches(index, phrases), "dc-found")
    end = (F.col("start") + F.col("n")).cast("long").alias("end")
    hits = found.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), end))).alias("spans"))
    hits = hits.select(*KEY, covered_words(F.col("spans")).alias("n_hit"))
    of = win.join(phrases, "phrase").select("phrase_id", "item").distinct()
    named = found.select("phrase_id", *KEY).distinct().join(of, "phrase_id").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = store(hits.join(named, KEY), "dc-hits")
    rows = _keyed(docs, id_col, text_col).select("doc_id", *KEY, F.size("words").cast("long").alias("n_words")).join(both, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    def words(text):
        return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{TERM}')"

    return rf"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM {documents}),
b AS (SELECT item_id::VARCHAR AS item, {words("text")} AS w FROM {benchmark}),
win AS (SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM (SELECT *, least({WIDTH}, len(w)) AS k FROM b) WHERE k > 0),
lens AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, unnest(p) AS phrase, unnest(range(0, len(p))) AS i
        FROM (SELECT doc_id, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS p FROM d, lens)),
m AS (SELECT pos.* FROM pos SEMI JOIN win USING (phrase, k)),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM m) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m JOIN win USING (phrase, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""
