"""Order-dependent selections: one-to-one matching, links with a degree limit, diverse sets, evenly spread picks, batches.

Greedy picks look at few rows, however many there are: what an earlier pick can block has a bound, so window ranks and a top-k
leave a bounded list that holds every pick, and only this list is walked in one task. Batches, whose sums restart, are
numbered partition by partition: each partition sums up, for every place where its first batch can break, what follows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.storage import numbered, ordered_parts, written

# Types that are kept, overlap of members that makes two alike, and that which does beside two common items.
MOST_TYPES, ALIKE, PARTLY_ALIKE = 16, 0.35, 0.2


def walk(rows: DataFrame, order: Sequence[Column], fresh: Callable[[], Callable[[dict], bool]]) -> DataFrame:
    """Rows, in order, that a stateful predicate accepts. `fresh` makes the predicate for a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accepts = fresh()
        for frame in frames:
            yield frame[[accepts(row) for row in frame.to_dict("records")]]

    return rows.repartition(1).sortWithinPartitions(*order).mapInPandas(run, rows.schema)


def matched_pairs(pairs: DataFrame, most: int = 8) -> DataFrame:
    """(a, b, score) by falling score, each a and each b once, at most `most` pairs.

    A pick is among the first `most` of its a and of its b, since at most most - 1 others can be taken before; and at most
    2 * (most - 1) taken ends block `most` listed rows each before the last pick.
    """

    def fresh():
        seen_a, seen_b = set(), set()

        def accepts(row: dict) -> bool:
            if len(seen_a) >= most or row["a"] in seen_a or row["b"] in seen_b:
                return False
            seen_a.add(row["a"])
            seen_b.add(row["b"])
            return True

        return accepts

    near = pairs
    for side in ("a", "b"):
        nth = F.row_number().over(Window.partitionBy(side).orderBy(F.desc("score"), "a", "b"))
        ranks = pairs.select("a", "b", nth.alias("_n")).filter(F.col("_n") <= most).select("a", "b")
        near = near.join(ranks, ["a", "b"], "left_semi")
    order = [F.desc("score"), F.col("a"), F.col("b")]
    return walk(near.orderBy(*order).limit(2 * most * most), order, fresh)


def degree_limited(links: DataFrame, degree: int = 3, most: int = 60) -> DataFrame:
    """(a, b, score) by falling score while both ends have fewer than `degree` links; the first `most` of them.

    `most` links fill at most 2 * most / degree ends, and only filled ends block; so a link that is taken is among the first
    degree + full of both ends, and fewer than full * (degree + full) listed rows are passed over before the last one.
    """

    def fresh():
        used, kept = Counter(), [0]

        def accepts(row: dict) -> bool:
            if kept[0] >= most or max(used[row["a"]], used[row["b"]]) >= degree:
                return False
            used.update((row["a"], row["b"]))
            kept[0] += 1
            return True

        return accepts

    full = 2 * most // degree
    ends = links.select(F.explode(F.array("a", "b")).alias("_end"), "a", "b", "score")
    nth = F.row_number().over(Window.partitionBy("_end").orderBy(F.desc("score"), "a", "b"))
    listed = ends.withColumn("_n", nth).filter(F.col("_n") <= degree + full).groupBy("a", "b").agg(F.count("*").alias("_k"))
    near = links.join(listed.filter("_k = 2").select("a", "b"), ["a", "b"], "left_semi")
    order = [F.desc("score"), F.col("a"), F.col("b")]
    return walk(near.orderBy(*order).limit(most + full * (degree + full)), order, fresh)


def diverse_sets(sets: DataFrame, most: int = MOST_TYPES, jaccard: float = ALIKE, share: float = PARTLY_ALIKE) -> DataFrame:
    """(score, items, members) by falling score, leaving out sets too like one that was chosen.

    Alike: members overlap beyond `jaccard`, items contain each other, or two items and over `share` of members agree.
    What a chosen set blocks has no bound, so all candidates that support and lift have left are read, in one streaming pass of a
    single task that holds the chosen sets only.
    """

    def fresh():
        chosen: list[tuple[frozenset, frozenset]] = []

        def alike(items: frozenset, members: frozenset, other: tuple[frozenset, frozenset]) -> bool:
            common = len(members & other[1])
            return (
                common > jaccard * len(members | other[1])
                or items <= other[0]
                or items >= other[0]
                or (len(items & other[0]) >= 2 and common > share * len(members))
            )

        def accepts(row: dict) -> bool:
            mine = frozenset(row["items"]), frozenset(row["members"])
            if len(chosen) >= most or any(alike(*mine, other) for other in chosen):
                return False
            chosen.append(mine)
            return True

        return accepts

    return walk(sets, [F.desc("score"), F.col("items")], fresh)


def spread(rows: DataFrame, record: str, order: Sequence[Column], k: int) -> DataFrame:
    """Every (n / k)-th row in order, one for each record, up to k."""
    placed = numbered(rows, list(order), "_at")
    step = max(1, placed.count() // k)
    picked = placed.filter(F.col("_at") % step == 0)
    first = picked.withColumn("_nth", F.row_number().over(Window.partitionBy(record).orderBy("_at"))).filter("_nth = 1")
    return first.orderBy("_at").limit(k).drop("_at", "_nth")


def _breaks(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a partition where a batch may begin: batches that follow it there, and words held at the end."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    n = len(sizes)
    # A batch from row i takes rows while they fit; a first row that does not fit stands with the empty rows before it.
    start = np.arange(n)
    ends = np.searchsorted(total, total[start] + limit, side="right") - 1
    first_full = np.searchsorted(total, total[start], side="right") - 1
    ends = np.maximum(ends, np.minimum(first_full + 1, n))
    follow, held = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        e = int(ends[i])
        if e >= n:
            held[i] = total[n] - total[i]
        else:
            follow[i], held[i] = follow[e] + 1, held[e]
    return follow, held


def batches(rows: DataFrame, order: Sequence[Column], size: str, limit: int) -> DataFrame:
    """rows with `batch` (from 1): neighbours in order share one while their sizes stay within limit.

    The sum restarts where a batch is full. A partition enters with the words held so far, which decide where its first batch
    breaks; it reports for each place where that can be (within its first `limit` words) how many batches follow and
    what is held at its end. The driver strings these together, a few rows a partition, and the second pass numbers.
    """
    spread_rows, _ = ordered_parts(rows, *order)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = written(spread_rows.withColumn("_at", place), "batch_rows")
    sizes = placed.select("_part", "_at", F.col(size).cast("long").alias("_n"))

    def report(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("_at")["_n"].to_numpy()
        total = np.concatenate(([0], np.cumsum(values)))
        follow, held = _breaks(values, limit)
        # With something held, a first break comes before a row that is not empty, within the first `limit` words; or at
        # once, if what is held is a single row beyond the limit.
        at = np.union1d([0], np.flatnonzero((values > 0) & (total[:-1] < limit)))
        return pd.DataFrame({"_part": frame["_part"].iloc[0], "at": at, "reach": total[at + 1], "follow": follow[at], "held": held[at], "total": total[-1]})

    kind = "_part long, at long, reach long, follow long, held long, total long"
    reports: dict[int, list] = {}
    for r in sizes.groupBy("_part").applyInPandas(report, kind).collect():
        reports.setdefault(r["_part"], []).append(r)
    entries, batch, holding = [], 1, 0
    for part in sorted(reports):
        entries.append((part, batch, holding))
        places = sorted(reports[part], key=lambda r: r["at"])
        if holding == 0:
            # Nothing held: the batch goes on from the partition's first row, whatever its size.
            batch, holding = batch + places[0]["follow"], places[0]["held"]
            continue
        first = next((r for r in places if holding + r["reach"] > limit), None)
        if first is None:
            holding += places[0]["total"]
        else:
            batch, holding = batch + 1 + first["follow"], first["held"]
    starts = rows.sparkSession.createDataFrame(entries or [(0, 1, 0)], "_part int, _batch int, _held long")

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at")
        batch, held = int(frame["_batch"].iloc[0]), int(frame["_held"].iloc[0])
        numbers = []
        for n in frame["_n"]:
            if held and held + n > limit:
                batch, held = batch + 1, 0
            held += n
            numbers.append(batch)
        return pd.DataFrame({"_part": frame["_part"], "_at": frame["_at"], "batch": numbers})

    numbers = sizes.join(F.broadcast(starts), "_part").groupBy("_part").applyInPandas(number, "_part int, _at int, batch int")
    return placed.join(numbers, ["_part", "_at"]).drop("_part", "_at")
