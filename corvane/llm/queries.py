"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import sql
from corvane.llm.common import read_table
from corvane.llm.decontam import contaminated
from corvane.llm.exact_dedup import exact_duplicates
from corvane.llm.language_id import detect_languages
from corvane.llm.lm_score import score_texts
from corvane.llm.mixing import mix_sources
from corvane.llm.phrase_dedup import remove_repeats
from corvane.llm.simhash import near_duplicates
from corvane.llm.token_count import count_tokens
from corvane.llm.toxicity import score_toxicity
from corvane.llm.url_filter import judge_urls


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op5_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_languages(read_table(spark, sf_dir, "documents"))


def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op7_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("spans")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("n_chunks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_context_mixing,
        op2_entropy_mix,
        op3_simhash_bktree,
        op4_url_vocabulary,
        op5_byte_gru,
        op6_phrase_automata,
        op7_toxic_crf,
        op8_token_counts,
        op9_decontamination,
        op10_chunk_recipes,
    )
}

ORACLES: dict[str, str] = sql.ORACLES
