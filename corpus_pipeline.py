"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again for the next.

Language identification drops documents it cannot place, exact dedup keeps the largest doc_id of equal texts, SimHash
keeps the smallest doc_id of each near-duplicate group, decontamination drops documents with a benchmark passage, and
the last stage mixes what is left to the target weights of the sources: its rows are the mix, each document as often as
it is taken, numbered by `copy`.

Rows are dropped, not ids: of rows that share an id, or have none, each is judged for itself, and of equal rows one
stays. Where a stage keeps the row with the largest or smallest doc_id, rows without an id yield to rows with one and
equal ids are told apart by their place in the file. Every stage reads all that its predecessor kept and, but for the
last, returns the columns of its input. A stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import ROW, discard, read_table, row_keyed, without_rows, written
from corvane.llm.decontam import judged
from corvane.llm.exact_dedup import exact_duplicates
from corvane.llm.language_id import UNKNOWN, judge_languages
from corvane.llm.mixing import mixed
from corvane.llm.simhash import near_duplicates

#: A document is rejected when its best language has less than this share.
MIN_LANGUAGE_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose best language has too small a share. Without any labelled
    language there is no model, and only texts without a letter go."""
    # Other columns pass under numbers, so that no name clashes with the result's.
    names = {c: c if c in ("doc_id", "text", "lang") else f"_{i}" for i, c in enumerate(docs.columns)}
    found = judge_languages(docs.toDF(*names.values()))
    placed = F.when(F.col("lang_pred") == UNKNOWN, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    kept = found.filter(placed.otherwise(F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col(new).alias(c) for c, new in names.items()])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = row_keyed(docs)
    named = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", ROW)
    found = exact_duplicates(keyed.select(named.alias("doc_id"), "text"))
    return without_rows(keyed, found.filter("not kept").select(f"doc_id.{ROW}"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = row_keyed(docs)
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)
    found = near_duplicates(keyed.select(named.alias("doc_id"), "text"))
    return without_rows(keyed, found.filter("component_id <> doc_id").select(f"doc_id.{ROW}"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = row_keyed(docs)
    found = judged(keyed.select("doc_id", "text", ROW), read_table(spark, sf_dir, "benchmark"))
    return without_rows(keyed, found.filter("contaminated").select(ROW))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mix_stage),
]

#: Trained language identification and rounding by hash have no SQL form; the tests compare every stage's rows with a
#: brute-force version of its decision.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
