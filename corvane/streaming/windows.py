"""Streaming forms of the run and rate queries: event time, watermarks and state that expires."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.relational import apply_upsert
from corvane.sources.plugins import publish, published


def read_stream(spark: SparkSession, path: str, schema, files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def closed_sessions(events: DataFrame, key: str, at: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that got no event for `gap`: first and last event and their number."""
    session = F.session_window(at, gap)
    found = events.withWatermark(at, late).groupBy(key, session.alias("w"))
    return found.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("w")


def rate_alerts(events: DataFrame, key: str, at: str, limit: int = 10, width: str = "60 seconds", slide: str = "10 seconds",
                late: str = "1 minute") -> DataFrame:
    """Sliding windows in which a key has at least `limit` events."""
    counted = events.withWatermark(at, late).groupBy(key, F.window(at, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= limit).select(key, F.col("w.start").alias("start"), "n")


def calendar_counts(events: DataFrame, at: str, unit: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling counts."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, unit).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n")


def first_arrivals(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark, for memo tables that must not compute a text twice."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("path", target).option("checkpointLocation", checkpoint).start().awaitTermination()


def follow_listing(stream: DataFrame, store: str, schema: str, key: str, checkpoint: str) -> None:
    """Apply every batch of listing rows to a published store and stop when there are no more.

    A batch is published under its own number in one step, so one that is run again after a failure gives the same store.
    Of rows of one key in a batch the last by `listed_at` counts.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "listed_at").alias("_r"))
        listing = latest.select(key, "_r.*").drop("listed_at")
        try:
            stored = published(spark, store, "records")
        except AnalysisException:  # nothing published yet
            stored = spark.createDataFrame([], schema)
        publish({"records": apply_upsert(listing, stored, key)}, store, f"batch-{number}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
