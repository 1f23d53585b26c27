"""Registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loghawk.llm import decontaminate, exact_dedup, mixing, ranked_search
from loghawk.llm.common import table
from loghawk.llm.decontaminate import contaminated
from loghawk.llm.exact_dedup import exact_duplicates
from loghawk.llm.line_dedup import dedup_lines
from loghawk.llm.main_text import main_text
from loghawk.llm.mixing import mix_sources
from loghawk.llm.near_dedup import near_duplicates
from loghawk.llm.neighbours import nearest
from loghawk.llm.packing import pack_documents
from loghawk.llm.periodic_runs import periodic_runs, repeated_tail
from loghawk.llm.quality import quality_scores
from loghawk.llm.ranked_search import search
from loghawk.llm.repeats import remove_repeats
from loghawk.llm.secret_scan import scan

#: File of the public tokenizers that the packing query uses.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, rows=6)


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), tail=repeated_tail)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_nearest_neighbours, op3_line_dedup, op4_main_text, op5_minhash_near_dedup,
    op6_repeated_strings, op7_mix_sources, op8_quality_scores, op9_best_fit_packing, op10_exact_dedup,
    op11_ranked_search, op12_periodic_runs, op13_decontamination)}

ORACLE: dict[str, str] = {
    "op7_mix_sources": mixing.oracle(),
    "op10_exact_dedup": exact_dedup.oracle(),
    "op11_ranked_search": ranked_search.oracle(),
    "op13_decontamination": decontaminate.oracle(),
}
