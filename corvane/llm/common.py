"""Pieces that several operators share: word patterns, folds, written tables and skew-safe joins."""

from __future__ import annotations

import os
import string

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import discard, ranked, shared_dir, written  # noqa: F401  the operators take them from here

#: A word: a maximal run without ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"

#: A key counts as hot when it holds at least this share of the rows, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.001


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id is fold 1 (never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(1))


ROW = "_row"


def row_keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, a key of its own for each row, the same whenever the row is read again.

    A plain read of files takes the row's place in its file; anything else is written once with numbers.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() == "LogicalRelation":
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        try:
            return docs.select("*", place.alias(ROW))
        except AnalysisException:  # a relation that is no files
            pass
    number = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return written(docs.withColumn(ROW, number), "rows")


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many rows with one row per group, safe when one group holds a large share of the rows.

    groups has the group's number of rows in the column `size`. Groups with at least HOT_SHARE of all rows number
    at most 1 / HOT_SHARE whatever the input, so they are broadcast and their rows are not shuffled; the other
    rows are dealt by the key. Null keys match nothing.
    """
    bar = max(2.0, total * HOT_SHARE)
    hot = groups.filter(F.col(size) >= bar)
    cold = groups.filter(F.col(size) < bar)
    hot_keys = hot.select(key, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot_keys), key, "left")
    of_hot = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    # Merged and never broadcast, even where it would fit: a broadcast of groups passes through the driver.
    of_cold = marked.filter("_hot is null").drop("_hot").join(cold.hint("merge"), key)
    return of_hot.unionByName(of_cold)


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs (with ROW) without the rows whose key is in dropped, and without the key."""
    return docs.join(dropped.select(ROW), ROW, "left_anti").drop(ROW)


def default_tokenizer(name: str) -> str:
    """Place of a public vocabulary file; CORVANE_TOKENIZERS names another folder."""
    if folder := os.environ.get("CORVANE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
