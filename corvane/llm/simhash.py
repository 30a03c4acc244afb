"""SimHash near-duplicate detection with BK-trees.

A fingerprint has a bit set when more than half of the XXH64 values (seed 42) of the text's word shingles have it;
texts without words have fingerprint zero. Fingerprints link at RADIUS or fewer differing bits.

Only different fingerprints are compared. The 64 bits are cut into RADIUS + 2 blocks: of two linked fingerprints at
least two blocks agree, so meeting in one of the 15 tables keyed by two blocks misses no link. The fingerprints of
a table key are a shard with a BK-tree: children hang on their integer Hamming distance to the parent, and a search
follows only edges within the radius of the distance at hand. Shards go to the tasks by a shuffle and not by a
broadcast, as all trees together grow with the corpus. A key with more than SHARD fingerprints is cut again: of the bits
outside its two blocks linked fingerprints differ in at most RADIUS as well, so the rest is cut into RADIUS + 2
pieces of which two agree, which makes 15 finer keys of some 36 bits. Only where even those are crowded (many
fingerprints that differ in few bits) are they split in parts that meet pairwise, so no task holds more than about two
parts. A tree reports a spanning forest of its links, which keeps every component and never lists all pairs of a group.

Defined results: null and word-less texts link to each other; rows with the same id get the same component only if
their texts link; a component's id is its smallest doc_id (null ids do not count; a component without any id has a null one).
An empty table gives an empty result, repeated rows are rows of one fingerprint, and texts of any length are read whole.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_by_group, lower_az, written
from corvane.llm.components import components
from corvane.llm.token_count import ascii_words, slices

SHINGLE, RADIUS, SEED, SHARD = 4, 4, 42, 1024
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(words: pa.Array, sizes: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts, in order, and the number of each text's shingles."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)).astype(np.int64)
    text = b" ".join(words.cast(pa.binary()).to_pylist())
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[: len(lengths)]
    ends = starts + lengths
    count = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    first = offsets[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(first + width, offsets[owner + 1]) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(text[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)),
        np.uint64,
        len(first),
    ), count


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprints: the bits that more than half of each text's hashes have."""
    out = np.zeros(len(count), np.uint64)
    if not len(hashes):
        return out
    # Runs of at most 255 hashes of one text: eight byte lanes count in a word without overflow.
    ends = np.cumsum(count)
    runs = -(-count // 255)
    run_owner = np.repeat(np.arange(len(count)), runs)
    run_no = np.arange(len(run_owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    run_start = (ends - count)[run_owner] + 255 * run_no
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, run_start)
        for lane in range(8):
            ones = np.bincount(run_owner, (lanes >> np.uint64(8 * lane)) & np.uint64(255), len(count))
            out |= (2 * ones > count).astype(np.uint64) << np.uint64(8 * lane + shift)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, count = shingle_hashes(*ascii_words(part.column(1)), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(majority_bits(hashes, count).view(np.int64))], names=["doc_id", "fp"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", lower_az(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


class BkTree:
    """Fingerprints under a metric: node = (value, {distance: child})."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            other, children = stack.pop()
            d = (other ^ value).bit_count()
            if d <= radius:
                found.append(other)
            if children:
                stack += [c for e, c in children.items() if d - radius <= e <= d + radius]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between values: (value, its root)."""
    tree, parent = BkTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        if value in parent:
            continue
        parent[value] = value
        for other in tree.within(value, radius):
            a, b = root(other), root(value)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    return [(v, r) for v in parent if (r := root(v)) != v]


def _trees(radius: int):
    """Links of sorted rows (key, finer, pair, fp): one tree for each run of equal (key, finer, pair)."""
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray):
            u, v = [], []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 1:
                    for x, r in shard_links([i & mask for i in fps[s:e].tolist()], radius):
                        u.append(x)
                        v.append(r)
            pair = [np.array(x, np.uint64).view(np.int64) for x in (u, v)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["u", "v"])

        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            change = np.flatnonzero((np.diff(rows[:3], axis=1) != 0).any(axis=0)) + 1
            if not len(change):
                held = rows
                continue
            starts = np.concatenate(([0], change[:-1]))
            yield links(rows[3], starts, change)
            held = rows[:, change[-1] :]
        if held.shape[1]:
            yield links(held[3], np.array([0]), np.array([held.shape[1]]))

    return run


def _cuts(bits: int, n: int) -> list[int]:
    return [round(bits * i / n) for i in range(n + 1)]


def _bits(value: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))


def _joined(parts: list[tuple[Column, int]]) -> Column:
    """Bit fields (value, width) side by side in one long."""
    out = F.lit(0).cast("long")
    for value, width in parts:
        out = F.shiftleft(out, width).bitwiseOR(value)
    return out


def block_keys(value: Column, bits: int = 64, radius: int = RADIUS) -> Column:
    """One (key, rest) for each pair of radius + 2 blocks of a value's bits: the number of the pair above the bits of
    both blocks, and all other bits."""
    cuts = _cuts(bits, radius + 2)
    blocks = [(_bits(value, a, b), b - a) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for table, pair in enumerate(combinations(range(len(blocks)), 2)):
        both = _joined([blocks[k] for k in pair]).bitwiseOR(F.lit(table << 40).cast("long"))
        rest = _joined([b for k, b in enumerate(blocks) if k not in pair])
        keys.append(F.struct(both.alias("key"), rest.alias("rest")))
    return F.array(*keys)


def _rest_bits(radius: int) -> int:
    """Bits outside two blocks, at most."""
    widths = sorted(b - a for a, b in zip(_cuts(64, radius + 2), _cuts(64, radius + 2)[1:]))
    return 64 - widths[0] - widths[1]


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints linked by chains of distances up to radius."""
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), 64, radius)).alias("k"))
    keyed = keyed.select("fp", "k.key", "k.rest", F.lit(-1).cast("long").alias("finer"))
    sizes = keyed.groupBy("key").count().filter("count > 1")
    met = keyed.join(sizes.hint("merge"), "key")
    crowded = met.filter(F.col("count") > shard).drop("count", "finer")
    finer = crowded.select("fp", "key", F.explode(block_keys(F.col("rest"), _rest_bits(radius), radius)).alias("k"))
    finer = finer.select("fp", "key", F.col("k.key").alias("finer"))
    finer_sizes = finer.groupBy("key", "finer").count().filter("count > 1")
    split = met.filter(F.col("count") <= shard).select("fp", "key", "finer", "count")
    split = split.unionByName(finer.join(finer_sizes.hint("merge"), ["key", "finer"]))
    split = split.withColumn("parts", F.ceil(F.col("count") / shard).cast("long"))
    split = split.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pair = F.struct(F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    grouped = split.select("key", "finer", F.xxhash64(pair).alias("pair"), "fp")
    return (
        grouped.repartition("key", "finer", "pair")
        .sortWithinPartitions("key", "finer", "pair", "fp")
        .mapInArrow(_trees(radius), "u long, v long")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, fp_rows (rows with this fingerprint) for every row of docs."""
    prints = written(fingerprints(docs), "fingerprints")
    fps = written(
        prints.groupBy("fp").agg(F.count("*").alias("fp_rows"), F.min("doc_id").alias("least")), "distinct_fps"
    )
    roots = components(link_fingerprints(fps.select("fp"), radius))
    rooted = written(
        fps.join(roots, fps["fp"] == roots["node"], "left").select(
            "fp", "fp_rows", "least", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    labelled = join_by_group(rooted, written(ids, "component_ids"), "root", "members", fps.count())
    labelled = written(labelled.select("fp", "fp_rows", "component_id"), "labelled")
    return join_by_group(prints, labelled, "fp", "fp_rows", prints.count()).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp_rows"
    )
