"""Listing files, nested snapshots, curated files and reading batches as sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.metadata import clean_title, normal_place
from corvane.operators.episodes import merged_latest, problems, validated
from corvane.operators.selection import batches


def read_listing(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV listing as trimmed strings: header without BOM and blanks, unnamed columns dropped, rows kept where all
    `required` columns have a value. Quoted fields may hold commas, doubled quotes and line breaks."""
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "inferSchema": False, "encoding": "UTF-8"}
    raw = spark.read.options(**options).csv(path)
    named = [(c, c.lstrip("﻿").strip()) for c in raw.columns]
    kept = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in named if n and not _unnamed(n)]
    rows = raw.select(*kept)
    for column in required:
        rows = rows.filter(F.col(f"`{column}`") != "")
    return rows


def _unnamed(name: str) -> bool:
    return name.startswith("_c") and name[2:].isdigit()


def fullest(candidates: DataFrame, source: str) -> DataFrame:
    """Rows of the candidate listing with most rows, the first name on ties."""
    best = candidates.groupBy(source).count().orderBy(F.desc("count"), source).limit(1)
    return candidates.join(F.broadcast(best.select(source)), source, "left_semi")


def write_snapshot(records: DataFrame, pages: DataFrame, path: str, key: str = "record", tags: DataFrame | None = None,
                   releases: DataFrame | None = None) -> None:
    """Records with their pages and tags nested in order, unfinished ones set back to `new`, as gzip JSON lines under
    path/records; releases, where given, under path/releases."""
    nest = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in df.columns if c != key]))).alias(name))
    status = F.when(F.col("status").isin("classified", "unavailable", "skipped"), F.col("status")).otherwise("new")
    out = records.withColumn("status", status).join(nest(pages, "pages"), key, "left")
    if tags is not None:
        out = out.join(nest(tags, "tags"), key, "left")
    out.write.mode("overwrite").option("compression", "gzip").json(f"{path}/records")
    if releases is not None:
        releases.write.mode("overwrite").option("compression", "gzip").json(f"{path}/releases")


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str, stored: DataFrame | None = None,
                  key: str = "record") -> tuple[DataFrame, DataFrame]:
    """(records, pages) of a snapshot; a snapshot only fills an empty store, so with stored rows both are empty.

    Titles and places are cleaned as a new listing's are, and a record's text is put together from its pages again.
    """
    nested = spark.read.schema(schema).json(f"{path}/records")
    if stored is not None and not stored.isEmpty():
        nested = nested.limit(0)
    said = F.filter(F.coalesce("pages", F.array().cast(nested.schema["pages"].dataType)), lambda p: F.trim(p["text"]) != "")
    blocks = F.transform(said, lambda p: F.concat(F.lit("[Page "), p["page"].cast("string"), F.lit("]\n"), p["text"]))
    records = nested.withColumn("text", F.array_join(blocks, "\n\n"))
    if "title" in nested.columns:
        records = records.withColumn("title", clean_title(F.col("title")))
    if "place" in nested.columns:
        records = records.withColumn("place", normal_place(F.col("place")))
    return records.drop("pages"), nested.select(key, F.inline("pages"))


def write_curated(episodes: DataFrame, path: str, key: str = "record") -> None:
    """One JSON line for each record with its episodes nested, sorted by record within each file."""
    columns = [F.col(c) for c in episodes.columns if c != key]
    nested = episodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("episodes"))
    nested.sortWithinPartitions(key).write.mode("overwrite").option("compression", "gzip").json(path)


def read_curated(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "record") -> DataFrame:
    """Episodes of curated files; lines that are no valid JSON have a null key and are left out."""
    return spark.read.schema(schema).json(path).filter(F.col(key).isNotNull()).select(key, F.inline("episodes"))


def import_curated(old: DataFrame, new: DataFrame, key: str = "record") -> DataFrame:
    return merged_latest(old, new, key)


def import_batches(spark: SparkSession, path: str, schema: T.StructType | str, known: DataFrame, curated: DataFrame, classes: list[str],
                   details: list[str], outcomes: list[str], as_of_year: int) -> tuple[DataFrame, DataFrame]:
    """(curated with the read episodes, problems) of JSON files of read batches: a record that was read replaces its curated
    episodes, others stay; unknown records, unknown classes and empty summaries are reported and left out."""
    raw = spark.read.schema(schema).json(path).filter("record is not null")
    found = problems(raw, known, classes)
    own = raw.join(known.select("record"), "record", "left_semi")
    good = validated(own, classes, details, outcomes, as_of_year)
    return merged_latest(curated, good.select(*curated.columns), "record"), found


def write_reading_batches(records: DataFrame, path: str, size: str, limit: int = 140_000, key: str = "record") -> None:
    """Records in key order, neighbours together up to `limit` characters, one folder for each batch."""
    numbered = batches(records, [F.col(key)], size, limit)
    numbered.write.mode("overwrite").partitionBy("batch").json(path)


def archive_key(url: str | object) -> object:
    """Key under which a file is sought in a bundle: the decoded, lower-cased last part of its address."""
    column = F.col(url) if isinstance(url, str) else url
    return F.lower(F.try_url_decode(F.element_at(F.split(F.regexp_replace(column, r"[?#].*$", ""), "/"), -1)))


def blocked_page(status: object, body: object, phrases: list[str]) -> object:
    """Whether a reply is an error or a denial page: status from 400, or a phrase in the first 2,000 bytes."""
    head = F.lower(F.substring(body, 1, 2000).cast("string"))
    denied = [F.contains(head, F.lit(p.lower())) for p in phrases]
    out = status >= 400
    for d in denied:
        out = out | d
    return out
