"""Mixing sources to target weights by entropy balancing.

The mix gives each document a rate, how often it is taken, as close as possible (in relative entropy over words) to
taking everything once. For each source two token constraints hold: the words taken equal its target, and their
length profile leans to that of the whole corpus, i.e. the mean of log2(size), weighted by words, is drawn to the corpus mean
with strength 1 / RIDGE (a pull and not an equality, as a source may have no document as long or as short). No rate
exceeds the cap. Such rates are exponential tilts, min(cap, exp(a + b * lean)), lean being log2(size) less the corpus
mean, and the multipliers (a, b) of all sources solve a convex dual. Newton steps solve it: a step is one aggregation over a
histogram (source, size) of the documents, which tries several step lengths at once and keeps the best, so its cost does
not depend on the number of documents. A dual that is not solved after STEPS steps raises.

Rates become copies by error diffusion over the histogram from long documents to short ones: what one size class rounds
away the next makes up, and what is left at the end is met by single copies more or less. Within a class the documents
are ordered by a hash of their id, in salted buckets, so a class may hold any share of all rows.

Defined results: null text has size 0 and is taken 0 times; a null source is a source and comes last; empty input
gives an empty result; repeated rows are documents of their own; where equal rows share an id, which of them gets an odd
copy is not defined, their number is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import ROW, WORD, ranked, row_keyed, written

WEIGHTS, CAP, BUCKETS = (5.0, 2.0, 1.0), 3.0, 256
RIDGE, STEPS, TOLERANCE = 0.5, 100, 1e-9
_LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.02)


def sizes_of(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, a source key without nulls, and the columns to keep."""
    return docs.select(
        *keep,
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        "source",
    )


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add target to (source, source_size): shares by weight, stopped at cap times the size, the excess reshared.

    Filling stops where target = min(cap * size, level * weight) adds up to all words; the level rises from round
    to round until no further source is stopped. A round is one aggregation over the sources.
    """
    table = ranked(totals, "source", "rank")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    table = written(table.withColumn("weight", F.get(kinds, (F.col("rank") % len(weights)).cast("int"))), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.col("source_size") * cap
    while total:
        stopped = full <= level * F.col("weight")
        held, open_weight = table.agg(
            F.sum(F.when(stopped, full).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))
        ).first()
        new = (total - held) / open_weight if open_weight else level
        if new <= level * (1 + 1e-15):
            break
        level = new
    return table.withColumn("target", F.least(full, F.lit(level) * F.col("weight"))).drop("rank", "weight")


def _rate(a: Column, b: Column, lean: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(a + b * lean, F.lit(700.0))))


def _potential(a: Column, b: Column, lean: Column, cap: float) -> Column:
    """Integral of the rate: exp up to the cap, a straight line beyond it."""
    u = a + b * lean
    return F.when(u < math.log(cap), F.exp(u)).otherwise(cap * (1 + u - math.log(cap)))


def tilt(cells: DataFrame, targets: DataFrame, cap: float = CAP, ridge: float = RIDGE) -> DataFrame:
    """(src, a, b) for cells (src, size, lean, n) and targets (src, target), by Newton's method on the dual.

    For each source, with rate = min(cap, exp(a + b * lean)) and weight = n * size: sum(weight * rate) = target and
    sum(weight * rate * lean) = -ridge * target * b. A source whose target is cap times its words takes every
    document cap times (a is then large, b zero); one with nothing to take has no row.
    """
    mass = F.col("n") * F.col("size")
    work = cells.filter("size > 0").join(targets.filter("target > 0"), "src").withColumn("mass", mass.cast("double"))
    work = written(work.select("src", "lean", "mass", "target"), "cells")
    words = F.sum("mass")
    full = words * cap <= F.max("target") * (1 + 1e-12)
    state = work.groupBy("src").agg(
        F.when(full, 50.0).otherwise(F.log(F.max("target") / words)).alias("a"), F.lit(0.0).alias("b"), full.alias("full")
    )
    for _ in range(STEPS):
        a, b, t = F.col("a"), F.col("b"), F.col("target")
        rate = _rate(a, b, F.col("lean"), cap)
        slope = F.when(rate < cap, rate).otherwise(0.0)
        sums = work.join(state, "src").groupBy("src", "a", "b", "full", "target").agg(
            F.sum(F.col("mass") * rate).alias("f"),
            F.sum(F.col("mass") * rate * F.col("lean")).alias("g"),
            F.sum(F.col("mass") * slope).alias("h0"),
            F.sum(F.col("mass") * slope * F.col("lean")).alias("h1"),
            F.sum(F.col("mass") * slope * F.col("lean") * F.col("lean")).alias("h2"),
        )
        da, db = F.col("f") - t, F.col("g") + ridge * t * b
        h0, h2 = F.col("h0") + 1e-9 * t, F.col("h2") + ridge * t
        det = h0 * h2 - F.col("h1") * F.col("h1")
        step = sums.select(
            "src", "a", "b", "full",
            F.when(F.col("full"), 0.0).otherwise((F.col("h1") * db - h2 * da) / det).alias("sa"),
            F.when(F.col("full"), 0.0).otherwise((F.col("h1") * da - h0 * db) / det).alias("sb"),
            F.when(F.col("full"), 0.0).otherwise(F.greatest(F.abs(da), F.abs(db)) / t).alias("gap"),
        )
        step = written(step, "dual")
        if (step.agg(F.max("gap")).first()[0] or 0.0) < TOLERANCE:
            return step.select("src", "a", "b")
        tried = []
        for k, length in enumerate(_LENGTHS):
            na, nb = a + length * F.col("sa"), b + length * F.col("sb")
            value = F.sum(F.col("mass") * _potential(na, nb, F.col("lean"), cap)) - F.max(t * na - ridge / 2 * t * nb * nb)
            tried.append(F.struct(value.alias("value"), F.lit(k).alias("k")))
        best = work.join(step, "src").groupBy("src", "a", "b", "full", "sa", "sb").agg(F.array_min(F.array(*tried)).alias("best"))
        length = F.get(F.array(*map(F.lit, _LENGTHS)), F.col("best.k"))
        state = best.select("src", (a + length * F.col("sa")).alias("a"), (b + length * F.col("sb")).alias("b"), "full")
    raise RuntimeError(f"the dual is not solved after {STEPS} steps")


def _nearest(sizes: np.ndarray, copies: np.ndarray, most: np.ndarray, carry: float) -> tuple[int, int, float]:
    """One copy more of a class and one less of another (-1: of none) that leave the least of carry, and what is left."""
    more = np.append(np.flatnonzero((copies < most) & (sizes > 0)), -1)
    less = np.append(np.flatnonzero((copies > 0) & (sizes > 0)), -1)
    more_size, less_size = (np.where(k < 0, 0, sizes[k]) for k in (more, less))
    order = np.argsort(more_size, kind="stable")
    more, more_size = more[order], more_size[order]
    wanted = carry + less_size
    right = np.searchsorted(more_size, wanted).clip(0, len(more) - 1)
    left = (right - 1).clip(0)
    at = np.where(np.abs(wanted - more_size[left]) <= np.abs(wanted - more_size[right]), left, right)
    rest = wanted - more_size[at]
    k = int(np.argmin(np.abs(rest)))
    return int(more[at[k]]), int(less[k]), float(rest[k])


def _diffuse(cap: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, ignore_index=True)
        sizes, most = cells["size"].to_numpy(), (int(cap) * cells["n"]).to_numpy()
        copies, carry = np.zeros(len(cells), np.int64), 0.0
        for at, (size, n, rate) in enumerate(zip(cells["size"], cells["n"], cells["rate"], strict=True)):
            if size:
                wanted = n * rate + carry / size
                copies[at] = min(max(round(wanted), 0), most[at])
                carry = (wanted - copies[at]) * size
        # What is left at the end: single copies more or less that bring the sum nearer.
        for _ in range(8):
            more, less, rest = _nearest(sizes, copies, most, carry)
            if abs(rest) >= abs(carry) - 1e-9:
                break
            copies[more] += more >= 0
            copies[less] -= less >= 0
            carry = rest
        return cells.assign(copies=copies)[["src", "size", "n", "rate", "copies"]]

    return run


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with `copy` (from 1); rows that are not taken are not in it."""
    keyed = row_keyed(docs)
    plan = mix_sources(keyed, weights, cap, keep=[ROW]).filter("copies > 0").select(ROW, "copies")
    return keyed.join(plan, ROW).select(*docs.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate for every row of docs, and its columns to keep (which also
    tell apart rows with one id)."""
    sized = sizes_of(docs, keep).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    sized = written(sized, "sizes")
    buckets = written(sized.groupBy("src", "size", "bucket").agg(F.count("*").alias("in_bucket")), "hist")
    cells = buckets.groupBy("src", "size").agg(F.sum("in_bucket").alias("n"))
    mean = cells.filter("size > 0").agg(
        F.sum(F.col("n") * F.col("size") * F.log2("size")) / F.sum(F.col("n") * F.col("size"))
    ).first()[0]
    cells = written(cells.withColumn("lean", F.log2(F.greatest("size", F.lit(1))) - F.lit(mean or 0.0)), "leans")
    totals = sized.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(totals, weights, cap), "targets")
    dual = tilt(cells, targets.select("src", "target"), cap)
    rated = cells.join(dual, "src", "left").withColumn(
        "rate",
        F.when((F.col("size") > 0) & F.col("a").isNotNull(), _rate(F.col("a"), F.col("b"), F.col("lean"), cap)).otherwise(0.0),
    )
    # One group per source, one row per different size in it: the number of sizes does not follow the rows.
    copied = rated.select("src", "size", "n", "rate").groupBy("src").applyInPandas(
        _diffuse(cap), "src string, size long, n long, rate double, copies long"
    )
    before = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        buckets.withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
        .join(copied, ["src", "size"])
        .join(targets.select("src", "source_size", "target"), "src")
    )
    order = Window.partitionBy("src", "size", "bucket").orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id", *keep)
    out = sized.withColumn("at", F.row_number().over(order) - 1).join(plan, ["src", "size", "bucket"])
    copies = F.expr("copies div n + if(offset + at < copies % n, 1, 0)")
    return out.select(
        *keep,
        "doc_id",
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.cast("int").alias("copies"),
        "rate",
    )
