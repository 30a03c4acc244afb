"""Lift, co-occurrence, crosstabs, timelines, waves, tag similarity and recurring combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_PAIR, MIN_GROUP, MIN_SHARED, MIN_LIFT, TOP = 4, 8, 3, 1.3, 8


def cooccurrence(items: DataFrame, unit: str, item: str, least: int = MIN_PAIR) -> DataFrame:
    """Pairs a < b of items in the same unit, with count and lift (c/n) / ((ca/n)(cb/n))."""
    pairs = items.select(unit, item).distinct()
    single = pairs.groupBy(item).agg(F.count("*").alias("c"))
    total = pairs.agg(F.countDistinct(unit).alias("n"))
    left = pairs.select(unit, F.col(item).alias("a"))
    right = pairs.select(unit, F.col(item).alias("b"))
    both = left.join(right, unit).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    both = both.filter(F.col("n_both") >= least)
    out = both.join(single.select(F.col(item).alias("a"), F.col("c").alias("ca")), "a")
    out = out.join(single.select(F.col(item).alias("b"), F.col("c").alias("cb")), "b").join(F.broadcast(total))
    return out.select("a", "b", "n_both", F.bround(F.col("n_both") * F.col("n") / (F.col("ca") * F.col("cb")), 6).alias("lift"))


def lift_rows(items: DataFrame, record: str, item: str, inside: str, top: int = TOP) -> DataFrame:
    """Items that are typical of records with inside = true: share inside over share outside."""
    rows = items.select(record, item, inside).distinct()
    sizes = rows.select(record, inside).distinct().agg(
        F.count_if(F.col(inside)).alias("n_in"), F.count_if(~F.col(inside)).alias("n_out")
    )
    counts = rows.groupBy(item).agg(F.count_if(F.col(inside)).alias("c_in"), F.count_if(~F.col(inside)).alias("c_out"))
    lift = (F.col("c_in") * F.col("n_out")) / (F.greatest("c_out", F.lit(1)) * F.col("n_in"))
    return (
        counts.join(F.broadcast(sizes))
        .filter((F.col("n_in") >= MIN_GROUP) & (F.col("n_out") >= MIN_GROUP) & (F.col("c_in") >= MIN_SHARED))
        .withColumn("l", lift).filter(F.col("l") >= MIN_LIFT)
        .select(item, "c_in", "c_out", F.bround("l", 6).alias("lift"))
        .orderBy(F.desc("lift"), F.desc("c_in"), item).limit(top)
    )


def item_by_period(items: DataFrame, unit: str, item: str, period: str, least: int = 5) -> DataFrame:
    """Zero-filled item x period matrix of distinct units and their share of all units of the period."""
    rows = items.select(unit, item, period).distinct()
    totals = rows.select(unit, period).distinct().groupBy(period).agg(F.count("*").alias("total"))
    counts = rows.groupBy(item, period).agg(F.count("*").alias("c"))
    names = rows.groupBy(item).agg(F.count("*").alias("s")).filter(F.col("s") >= least).select(item)
    # Both dimensions are small: one row per item and one per period.
    grid = names.crossJoin(totals)
    return grid.join(counts, [item, period], "left").select(
        item, period, F.coalesce("c", F.lit(0)).alias("n"), F.bround(F.coalesce("c", F.lit(0)) / F.col("total"), 6).alias("share")
    )


def dense_calendar(counts: DataFrame, step: str) -> DataFrame:
    """(step, n) with a row for each integer step between the first and the last; missing ones are 0."""
    ends = counts.agg(F.min(step).alias("lo"), F.max(step).alias("hi"))
    days = ends.select(F.explode(F.sequence("lo", "hi")).alias(step))
    return days.join(counts, step, "left").select(step, F.coalesce("n", F.lit(0)).alias("n"))


def waves(calendar: DataFrame, step: str, reach: int = 10, gap: int = 1, least: int = 10, factor: float = 2.5,
          offset: float = 3.0) -> DataFrame:
    """Islands of steps far above their neighbourhood's median (within reach, beyond gap)."""
    apart = F.array(*[F.lit(k) for k in range(-reach, reach + 1) if abs(k) > gap])
    near = calendar.select(F.col("n").alias("m"), F.explode(F.transform(apart, lambda k: F.col(step) + k)).alias(step))
    base = calendar.join(near, step).groupBy(step, "n").agg(F.median("m").alias("base"))
    high = base.filter((F.col("n") >= least) & (F.col("n") >= factor * F.col("base") + offset))
    # A calendar has one row per step of time, so one window over it is small.
    w = Window.orderBy(step)
    start = F.coalesce((F.col(step) - F.lag(step).over(w) != 1).cast("int"), F.lit(1))
    island = high.withColumn("start", start).withColumn("island", F.sum("start").over(w))
    return island.groupBy("island").agg(
        F.min(step).alias("first"), F.max(step).alias("last"), F.sum("n").alias("total"),
        F.min_by(step, F.struct(-F.col("n"), F.col(step))).alias("peak"), F.max("base").alias("baseline"),
    ).drop("island")
