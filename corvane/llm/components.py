"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, join_by_group, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the smallest node reachable. Loops are ignored.

    A step takes each node's least neighbour (a partial aggregation) and joins it back to the edges; the nodes with a
    large share of all edges are few and broadcast (`join_by_group`), so a hub's edges stay where they are. Steps go
    on until nothing changes; their number grows with the logarithm of the longest chain.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = written(edges.filter("u <> v").select(high, low).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        least = written(least, "large_least")
        large = join_by_group(both, least, "u", "n", 2 * state[0]).filter("v > u")
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_star")
        small_least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small_least")
        kept = join_by_group(large, small_least, "u", "n", state[0]).filter("v <> m")
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
        for table in (now, least, large, small_least):
            discard(table)
        before, state, now = state, _state(after), after
        if state == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
