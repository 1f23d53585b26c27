"""The stages one after another, each held against its input."""

import collections
import hashlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from fixtures import SF, empty, odd  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__
from loghawk.llm import quality

STAGES = dict(corpus_pipeline.STAGES)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages(spark, tmp_path):
    """Each stage's output is what a plain version makes of its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if n < 4:
            assert sorted(out.columns) == sorted(columns), name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.count()
        given, made = before.collect(), docs.collect()
        if name == "quality":
            model = quality.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            score = lambda t: 1 / (1 + np.exp(-np.clip(model["slope"] * quality.margin(quality.features((t or "").encode(), np.zeros(quality.SIZE, bool)), model) + model["intercept"], -500, 500)))
            assert collections.Counter(made) == collections.Counter(r for r in given if score(r.text) >= 0.5)
        elif name == "line_dedup":
            blank = {sha("\n" * k) for k in range(300)}
            want = {i: (removed, digest) for i, _, removed, digest in brute.lines([(r.doc_id, r.text) for r in given])}
            assert {r.doc_id for r in made} == {i for i, (removed, digest) in want.items() if not removed or digest not in blank}
            before_of = {r.doc_id: r for r in given}
            for r in made:
                assert sha(r.text) == want[r.doc_id][1] and r[2:4] == before_of[r.doc_id][2:4]
                assert r.n_chars == (len(r.text) if want[r.doc_id][0] else before_of[r.doc_id].n_chars)
        elif name == "near_dedup":
            keep = {i for i, _, c in brute.near([(r.doc_id, r.text) for r in given], 5, 80) if i == c}
            assert collections.Counter(made) == collections.Counter(r for r in given if r.doc_id in keep)
        elif name == "mixing":
            texts = {r.doc_id: r.text for r in given}
            words = collections.Counter()
            for r in made:
                assert texts[r.doc_id] == r.text or " ".join(texts[r.doc_id].split()).startswith(r.text)
                words[r.source] += len(brute.WORD.findall(r.text))
            assert sum(words.values()) == pytest.approx(sum(len(brute.WORD.findall(t)) for t in texts.values()), rel=0.01)
    assert 0 < rows["near_dedup"] <= rows["line_dedup"] <= rows["quality"] < 200
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))
    assert names["pipeline"](spark, SF).count() > 0


#: Names that the stages use themselves, or might.
CLASHES = ["row", "id", "doc", "hash", "removed", "rest", "score", "gone", "words", "skey", "size", "taken", "__text", "__doc", "__removed", "__id", "__score"]


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "mixing"])
def test_columns_with_clashing_names_come_through(spark, odd, name):
    docs = odd.withColumns({c: F.concat(F.lit(f"mine {c} "), F.xxhash64("text", "source").cast("string")) for c in CLASHES})
    out = STAGES[name](spark, docs, SF)
    assert sorted(out.columns) == sorted(docs.columns)
    plain = STAGES[name](spark, odd, SF)
    assert rows_of(out.select("doc_id", "text", "source")) == rows_of(plain.select("doc_id", "text", "source"))
    given = {tuple(r) for r in docs.select("doc_id", *CLASHES).collect()}
    assert {tuple(r) for r in out.select("doc_id", *CLASHES).collect()} <= given


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and very long texts, repeated rows and ids, through all stages in turn."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}, name
    packed = STAGES["packing"](spark, docs, SF).collect()
    assert len({r.sequence_id for r in packed}) >= 1 and all(0 < r.length <= 4096 for r in packed)


def test_stages_on_empty_tables(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name


def test_repeated_rows_stay_or_go_together(spark):
    text = "one line here that is long enough\nanother line of its own\nthird line"
    docs = spark.createDataFrame([(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, "quite other words stand in this text", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    out = STAGES["near_dedup"](spark, STAGES["line_dedup"](spark, docs, SF), SF)
    assert sorted(r.doc_id for r in out.collect()) == [1, 1, 2]
