"""Pluggable sources and sinks: record sources, page readers, bundles, model readers, published results, JSON results."""

from __future__ import annotations

import importlib
import io
import json
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.functions import metadata as md
from corvane.operators.lifecycle import memoised

# Fixed value: pages of one file that are read.
MAX_PAGES = 5000


def named(path: str) -> Callable:
    """The function `package.module:name`."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class RecordSource(DataSource):
    """`spark.read.format("records").option("list", "package.module:function").schema(...)`: a source of records.

    The function takes the options and yields rows (dicts). With option `parts` it is called once for each part, in parallel,
    with `part` and `parts` among its options; it runs on the executors and never inside a query's expressions.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(schema, dict(self.options))


class _RecordReader(DataSourceReader):
    def __init__(self, schema, options: Mapping[str, str]):
        self.fields, self.options = [f.name for f in schema.fields], options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(int(self.options.get("parts", 1)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in named(self.options["list"])({**self.options, "part": str(partition.value)}):
            yield tuple(row.get(f) for f in self.fields)


def read_records(spark: SparkSession, function: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").schema(schema).options(list=function, **options).load()


def listing_links(html: Column, bundle: str, listing: str, fallback: str) -> Column:
    """struct(bundles, listings): distinct links of bundles, sorted, and of listings in the order first seen, a fixed
    address last. The patterns have one group, the link."""
    found = lambda p: F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(p), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))
    seen = F.array_distinct(F.concat(found(listing), F.array(F.lit(fallback))))
    return F.struct(F.array_sort(F.array_distinct(found(bundle))).alias("bundles"), seen.alias("listings"))


class PageReader(Protocol):
    """Reads the bytes of a file into (page number, text, method, confidence)."""

    def __call__(self, content: bytes) -> Iterator[tuple[int, str, str, float | None]]: ...


def plain_pages(content: bytes) -> Iterator[tuple[int, str, str, float | None]]:
    """Text files whose pages are parted by form feeds."""
    for n, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield n, text, "text", None


def read_pages(files: DataFrame, reader: PageReader = plain_pages, most: int = MAX_PAGES) -> DataFrame:
    """(path, page_no, text, method, confidence, error) of `binaryFile` rows; a file that cannot be read is one row with
    its error. At most `most` pages of a file are read: a documented limit of the reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    for page in reader(content.as_py()):
                        if len(rows) >= most:
                            break
                        rows.append((path, *page, None))
                except Exception as e:  # noqa: BLE001  whatever a reader raises belongs to its file
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "page_no", "text", "method", "confidence", "error"])

    kind = "path string, page_no int, text string, method string, confidence double, error string"
    return files.select("path", "content").mapInArrow(run, kind)


def bundle_members(files: DataFrame) -> DataFrame:
    """(path, member, key, content) of zip files among `binaryFile` rows; key is the decoded, lower-cased last part of the
    member's name. Broken archives and folders have no members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_py()))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    if not info.is_dir():
                        key = unquote(info.filename.rsplit("/", 1)[-1]).lower()
                        values = [[path], [info.filename], [key], [archive.read(info)]]
                        kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["path", "member", "key", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, key string, content binary")


def recovered(missing: DataFrame, members: DataFrame) -> DataFrame:
    """Missing files (release, key, ...) with the content of the member of the same key in a bundle of the same release;
    of several members the first by name."""
    first = members.groupBy("release", "key").agg(F.min_by("content", "member").alias("content"))
    return missing.join(first, ["release", "key"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size) of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", md.digest(F.col("content")).alias("d")).select("path", "d.sha256", "d.size")


def sniffed_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


class Model(Protocol):
    """Answers a prompt in the form of a schema, as a dict."""

    name: str

    def parse(self, system: str, prompt: str, schema: str) -> dict: ...


class EchoModel:
    """A model for tests: what it answers depends on the prompt alone."""

    name = "echo"

    def parse(self, system: str, prompt: str, schema: str) -> dict:
        return {"words": len(prompt.split()), "begins": prompt[:20]}


def read_with_model(texts: DataFrame, cache: DataFrame, model: Model, system: str, schema: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(all answers, new ones) as (key, answer, error) for texts (text): the key covers version, model and text, only keys
    without a cached row are asked, and a failure is a row with its error."""
    framed = F.concat_ws("\x1f", F.lit(version), F.lit(model.name), F.col("text"))
    keyed = texts.filter("text is not null").select(F.left(F.sha2(framed, 256), F.lit(32)).alias("key"), "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    answers.append(json.dumps(model.parse(system, text, schema), sort_keys=True))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever a model raises belongs to its text
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["key", "answer", "error"])

    fresh = lambda misses: misses.select("key", "text").mapInArrow(ask, "key string, answer string, error string")
    return memoised(keyed, cache, "key", fresh)


def publish(results: Mapping[str, DataFrame], path: str, version: str) -> None:
    """Write all results to a folder of their own, then point to it in one rename: a reader sees the old or the new ones."""
    if not results:
        raise ValueError("nothing to publish")
    spark = next(iter(results.values())).sparkSession
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(conf)
    draft, pointer = place(f"{path}/_draft.{version}"), place(f"{path}/CURRENT")
    out = files.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place(path).toUri() if "://" in path else files.getUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, pointer, overwrite)


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.text(f"{path}/CURRENT").first()[0]
    return spark.read.parquet(f"{path}/{version}/{name}")


def json_rows(df: DataFrame, columns: Sequence[str] | None = None, out: str = "json") -> DataFrame:
    """One JSON object a row, its nulls written."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias(out))


def save_table(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def load_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
