"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every benchmark window (ten consecutive words of an item; the whole item when it is shorter) orders its words by
rarity in the documents. A document that contains the window contains its rarest word, so that word is the
window's necessary prefix. Document words meet the prefix words in a hash join; position and length bounds drop
windows that would stick out of the document, and what is left is verified word by word. Occurrences become
covered positions and item lists.

The prefix table is broadcast in blocks of at most BLOCK_ROWS windows, one pass over the documents for each, so
the broadcast has a fixed bound however large the benchmark is. Nothing is emitted for pairs without a common
rarest word.

Defined results: null or word-less texts have no words and no hits; repeated items count once. The windows of an item
without an id hit like others, but the item is neither counted nor listed. Hits belong to rows, not to ids: rows
that share a doc_id, and rows without one, are judged by their own text. Items that share a window are gathered
by window, and windows with a large share of all occurrences meet their items by a broadcast of bounded size. Without
documents the result is empty, without a benchmark nothing is hit. Texts of any length are read whole, and other columns
may have any name but that of the row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ROW, join_by_group, lower_az, row_keyed, written

WINDOW, BLOCK_ROWS = 10, 100_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts whose A-Z are still there.
_GAP_OF_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), _GAP), "")


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, window): the different windows of each item, as arrays of words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return (
        items.filter(F.size("w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window"))
        .distinct()
    )


def _blocks(table: DataFrame, rows: int, most: int) -> list[DataFrame]:
    """table in hash blocks of about `most` rows each."""
    n = -(-rows // most)
    if n <= 1:
        return [table]
    return [table.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k) for k in range(n)]


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_rows: int = BLOCK_ROWS):
    """Verified occurrences (row key, start, stop, window) of benchmark windows in docs (with a row key), and the
    (item_id, window) table."""
    by_item = written(item_windows(benchmark, width), "windows")
    windows = written(by_item.select("window").distinct(), "distinct_windows")
    n_windows = windows.count()
    read = docs.select(ROW, words_of(F.col("text")).alias("w"))

    # How often each benchmark word occurs in the documents.
    vocabulary = written(windows.select(F.explode("window").alias("word")).distinct(), "vocabulary")
    seen = None
    n_words = vocabulary.count()
    parts = max(1, -(-n_words // block_rows))
    for k in range(parts):
        block = vocabulary if parts == 1 else vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == k)
        counted = (
            read.select(F.explode("w").alias("word")).join(F.broadcast(block), "word").groupBy("word").count()
        )
        seen = counted if seen is None else seen.unionByName(counted)
    rarity = written(vocabulary.join(seen, "word"), "rarity")

    # A window with a word that no document has occurs nowhere; the others keep their rarest word.
    spread = windows.select("window", F.posexplode("window").alias("at", "word"))
    prefix = written(
        spread.join(rarity, "word", "left")
        .groupBy("window")
        .agg(
            F.min(F.when(F.col("count").isNull(), F.lit(0)).otherwise(F.lit(1))).alias("possible"),
            F.min(F.struct("count", "word", "at")).alias("least"),
        )
        .filter("possible = 1")
        .select("window", F.col("least.word").alias("word"), F.col("least.at").alias("at"),
                F.size("window").alias("len")),
        "prefix",
    )
    found = None
    tokens = read.select(ROW, "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    for block in _blocks(prefix, n_windows, block_rows):
        start = F.col("pos") - F.col("at")
        hit = (
            tokens.join(F.broadcast(block), "word")
            .filter((start >= 0) & (start + F.col("len") <= F.col("n")))
            .filter(F.slice("w", start + 1, F.col("len")) == F.col("window"))
            .select(ROW, start.alias("start"), (start + F.col("len")).alias("stop"), "window")
        )
        found = hit if found is None else found.unionByName(hit)
    return written(found, "occurrences"), by_item


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    keyed = row_keyed(docs.select("doc_id", "text"))
    return judged(keyed, benchmark, width).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


def judged(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """`contaminated` for docs that have a row key, which the result keeps."""
    found, by_item = occurrences(docs, benchmark, width)
    spans = found.select(ROW, "start", "stop").distinct()
    # Covered positions: spans in order, each adding what lies beyond the furthest stop so far.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = spans.groupBy(ROW).agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("start", "stop"))),
            zero,
            lambda a, s: F.struct(
                F.greatest(a["end"], s["stop"]).alias("end"),
                (a["n"] + F.greatest(s["stop"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"),
            ),
        )["n"].alias("n_hit")
    )
    held = written(found.select(ROW, "window").distinct(), "row_windows")
    uses = held.groupBy("window").agg(F.count("*").alias("uses"))
    owners = by_item.filter("item_id is not null").groupBy("window").agg(F.collect_set("item_id").alias("owners"))
    groups = written(uses.join(owners, "window"), "window_items")
    pairs = join_by_group(held, groups, "window", "uses", held.count())
    pairs = pairs.select(ROW, F.explode("owners").alias("item_id")).distinct()
    items = pairs.groupBy(ROW).agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids")
    )
    counts = docs.select(
        "doc_id",
        ROW,
        # Gaps are a small set of characters and fast to find, words are not; so words are counted between gaps.
        F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _GAP_OF_ANY_CASE), "")).cast("long").alias("n_words"),
    )
    return counts.join(covered.join(items, ROW, "left"), ROW, "left").select(
        "doc_id",
        ROW,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
