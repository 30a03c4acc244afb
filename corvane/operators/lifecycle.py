"""States of records and runs: what is due, what is tried again, what is reset, what has gone stale."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tries of a failing record, minutes without a sign of life that end a run.
MAX_ATTEMPTS, STALE_MINUTES = 5, 10
# States that wait for work, states a reset touches, the state each stage starts from.
PENDING = ["new", "downloaded", "extracted", "failed", "unavailable"]
RESETTABLE = ["classified", "extracted", "failed"]
STAGE_START = {"extract": "downloaded", "classify": "extracted"}


def due(status: Column, attempts: Column, most: int = MAX_ATTEMPTS) -> Column:
    """Records to work on: pending ones, failed ones only while they have tries left."""
    return status.isin(*PENDING) & ((status != "failed") | (F.coalesce(attempts, F.lit(0)) < most))


def next_step(media: Column, status: Column, has_file: Column) -> Column:
    """What a due record needs: a fetch, text extraction, classification, or nothing that can be done."""
    paper = media == "pdf"
    return (
        F.when(paper & status.isin("new", "failed", "unavailable"), F.when(has_file, "fetch").otherwise("wait"))
        .when(paper & (status == "downloaded"), "extract")
        .otherwise("classify")
    )


def after_step(status: Column, step: Column, error: Column, attempts: Column) -> Column:
    """struct(status, attempts, error) once a step has ended; a failure counts as a try and keeps its message."""
    done = F.when(step == "fetch", "downloaded").when(step == "extract", "extracted").when(step == "classify", "classified").otherwise(status)
    failed = error.isNotNull()
    return F.struct(
        F.when(failed, "failed").otherwise(done).alias("status"),
        (F.coalesce(attempts, F.lit(0)) + failed.cast("int")).alias("attempts"),
        F.left(error, F.lit(2000)).alias("error"),
    )


def isolated(df: DataFrame, column: str, fn: Callable[[object], str], out: str = "result", error: str = "error") -> DataFrame:
    """df with fn(column), one row at a time, so that a row's failure is a value in `error` and stops nothing else."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])
    at = df.columns.index(column)

    def attempt(value: object) -> tuple[str | None, str | None]:
        try:
            return fn(value), None
        except Exception as e:  # noqa: BLE001  whatever the user's function raises belongs to its row
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [attempt(v) for v in batch.column(at).to_pylist()]
            made = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, out, error])

    return df.mapInArrow(run, schema)


def reset(records: DataFrame, stage: str, file: str, media: str = "media", status: str = "status", attempts: str = "attempts") -> DataFrame:
    """Records set back to a stage, their tries forgotten; papers whose file is gone must be fetched again."""
    start = STAGE_START[stage]
    fetched = F.when(F.col(file).isNull(), "new").otherwise(start) if stage == "extract" else F.lit(start)
    target = F.when(F.col(media) != "pdf", "extracted").otherwise(fetched)
    touched = F.col(status).isin(*RESETTABLE)
    return records.withColumns({
        status: F.when(touched, target).otherwise(F.col(status)),
        attempts: F.when(touched, 0).otherwise(F.col(attempts)),
    })


def must_rerun(worked: int, results_missing: bool, versions_differ: bool) -> bool:
    return worked > 0 or results_missing or versions_differ


def closed_runs(runs: DataFrame, now: Column, minutes: int = STALE_MINUTES, status: str = "status", beat: str = "beat") -> DataFrame:
    """Running runs without a sign of life for `minutes` become failed and end at their last one."""
    dead = (F.col(status) == "running") & (F.col(beat) < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return runs.withColumns({
        "finished": F.when(dead, F.col(beat)).otherwise(F.col("finished")),
        status: F.when(dead, "failed").otherwise(F.col(status)),
    })


def run_due(runs: DataFrame, now: Column, hours: float) -> DataFrame:
    """One row: whether the last finished run began at least `hours` ago (or there is none)."""
    last = F.max(F.when(F.col("status") == "finished", F.col("started")))
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0))
    return runs.agg(F.coalesce(last <= now - wait, F.lit(True)).alias("due"))


def latest_runs(runs: DataFrame, order: str, group: Sequence[str] = ()) -> DataFrame:
    """The latest and the one before, by group: number 1 and 2."""
    w = Window.partitionBy(*group).orderBy(F.desc(order))
    return runs.withColumn("number", F.row_number().over(w)).filter("number <= 2")


def over_rate(events: DataFrame, key: str, at: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Events by which a key has at least `limit` of them in less than `seconds`, with that number."""
    span = seconds * 1_000_000 - 1
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-span, 0)
    return events.withColumn("n", F.count("*").over(w)).filter(F.col("n") >= limit)


def budgeted(blocks: DataFrame, record: str, order: str, text: str, budget: int) -> DataFrame:
    """Blocks of each record, in order, while its budget of characters lasts: the first always stays, a block that would
    exceed the budget goes, a later one that still fits stays. A record's blocks meet as lengths only."""
    lengths = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("n"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("kept"))

    def step(state: Column, block: Column) -> Column:
        fits = (F.size(state["kept"]) == 0) | (state["used"] + block["n"] <= budget)
        used = state["used"] + F.when(fits, block["n"]).otherwise(0)
        return F.struct(used.cast("long").alias("used"), F.array_append(state["kept"], fits).alias("kept"))

    plan = blocks.groupBy(record).agg(lengths.alias("b")).withColumn("kept", F.aggregate("b", zero, step)["kept"])
    chosen = plan.select(record, F.explode(F.arrays_zip(F.col("b.o").alias("o"), "kept")).alias("z"))
    chosen = chosen.filter("z.kept").select(record, F.col("z.o").alias(order))
    return blocks.join(chosen, [record, order], "left_semi")


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, object]:
    """df whose counters are observed while whatever action runs, and the observation to read them from."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[F.count_if(c).alias(k) for k, c in counters.items()]), seen


def memoised(wanted: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all results, new ones) for distinct keys: cached rows as they are, `compute` only for the misses. Append the new
    ones to the cache batch by batch, and an interrupted run goes on where it stopped."""
    keys = wanted.dropDuplicates([key])
    fresh = compute(keys.join(cache.select(key), key, "left_anti"))
    return cache.join(keys.select(key), key, "left_semi").unionByName(fresh), fresh
