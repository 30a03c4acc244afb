"""Tables in the folder that driver and executors share, and plans that stay even when one key holds much."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests)
    makes one of its own; on a cluster that would be a folder no executor shares, so it raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(shared_dir, "own", None)
        if not at:
            at = shared_dir.own = tempfile.mkdtemp(prefix="corvane-")
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a partition that `dealt` makes: what a task then sorts or holds does not grow with the input.
DEALT = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df over partitions by key, as many as its rows ask for and as the session has at least. Without `rows` they are
    counted, so give a table that is read from files: Parquet holds their number."""
    n = df.count() if rows is None else rows
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-n // DEALT)), *keys)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that `written` returned, once nothing reads it any more."""
    spark = table.sparkSession
    inside = f"{shared_dir(spark)}/corvane/"
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        if inside.removeprefix("file:") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ordered_parts(df: DataFrame, *by) -> tuple[DataFrame, list[int]]:
    """df written in range partitions of the order `by`, each row with `_part` (dense from 0 in that order), and the
    partitions' row counts: all that reaches the driver."""
    spread = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    spread = written(spread, "ordered")
    counts = dict(spread.groupBy("_part").count().collect())
    parts = sorted(counts)
    if parts != list(range(len(parts))):
        numbers = df.sparkSession.createDataFrame(list(enumerate(parts)), "_n int, _part int")
        spread = spread.join(F.broadcast(numbers), "_part").drop("_part").withColumnRenamed("_n", "_part")
    return spread, [counts[p] for p in parts]


def ranked(df: DataFrame, by: str, out: str) -> DataFrame:
    """Global 0-based rank by a unique column (nulls last) without a single-partition sort."""
    return numbered(df, [F.col(by).asc_nulls_last()], out)


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Global 0-based row number in an order, without a single-partition sort: range partitions are numbered by their
    rows, and rows within them. Ties have some order, so end the order with a unique column."""
    spread, counts = ordered_parts(df, *order)
    starts, at = [], 0
    for part, n in enumerate(counts):
        starts.append((part, at))
        at += n
    within = Window.partitionBy("_part").orderBy(*order)
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _begin long")
    return (
        spread.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_begin") + F.row_number().over(within) - 1)
        .drop("_part", "_begin")
    )
