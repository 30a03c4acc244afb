"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words; a word goes when some window over it has a word sequence that starts earlier
(smaller doc_id, or earlier in the same document). Documents are packed once into blocks of a few megabytes.

1. Anchors. Each window elects the phrase of PHRASE words in it with the least hash, so equal windows elect equal
   phrases, and neighbours mostly elect the same one: about an eighth of the words start an elected phrase. Blocks
   send the hash and one place of each of their elected phrases to hash buckets, where phrases that occur again are
   confirmed and go back to their blocks.
2. Automata. The confirmed phrases of a block, read from their places, are compiled into a pyahocorasick automaton: the
   shard of all confirmed phrases that can occur in it. All documents of the block stream through it, and its hits
   are all that is known of where confirmed phrases stand: the windows around a hit are the candidates, named by the
   least hash among the hits they hold. (A window that occurs twice holds its elected phrase at both places, confirmed at
   both, and no phrase in it has a smaller hash; so both get the same name.) Windows that repeat inside the block are
   settled there; only a block's first occurrence of each goes on, so a passage that a large share of documents hold
   costs one record per block.
3. First occurrences. Buckets find the earliest occurrence of each window, known by 128 bits (name and window hash,
   independent), and send later ones back to their blocks as word ranges, where words go and digests are made.

Streaming every document through the automata of all other blocks would cost the square of the corpus; hashes
decide which phrases are worth a place in an automaton, the automata find where they occur.

Texts move compressed; what moves beside them is about 9 bytes for each recurring window.

Defined results: null text has no words; texts below WINDOW words lose nothing; rows with the same doc_id count as
the same document, so their equal windows at equal places are not earlier than each other (repeated rows lose
nothing to each other); a null id counts as the largest. An empty table gives an empty result; a text of any length is
whole in one block, which is then as large as the text. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import ranked, written
from corvane.llm.token_count import ascii_words, slices

WINDOW, PHRASE = 20, 6
BLOCK_BYTES, BUCKET_ROWS, GROUP_BLOCKS = 4 << 20, 400_000, 4096
_LAST, _NONE = np.iinfo(np.int64).max, np.uint64(2**64 - 1)
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(step: int, n: int) -> np.ndarray:
    if len(_POWERS.get(step, ())) < n:
        steps = np.full(max(n, 1 << 20), step, np.uint64)
        steps[0] = 1
        _POWERS[step] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[step][:n]


def _rolling(h: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """Hash of each run of `width` consecutive values: differences of a running polynomial, shifted back."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(int(multiplier), len(h)), dtype=np.uint64)))
    return _mix((total[width:] - total[:n]) * _powers(pow(int(multiplier), -1, 1 << 64), n))


class Block:
    """Words of a block's documents, and the starts of the windows in them."""

    def __init__(self, texts: pa.Array, window: int = WINDOW):
        self.words, self.sizes = ascii_words(texts)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        # Windows that lie within one document.
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        n = max(0, len(owner) - window + 1)
        self.at = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n else np.zeros(0, np.int64)
        self.doc = owner[self.at] if n else self.at
        self._window = window

    def word_hashes(self, seed: int) -> np.ndarray:
        coded = self.words.dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        codes = coded.indices.to_numpy() if len(names) else np.zeros(0, np.int32)
        return np.fromiter((xxhash.xxh64_intdigest(n, seed) for n in names), np.uint64, len(names))[codes]

    def phrase_hashes(self, phrase: int = PHRASE) -> np.ndarray:
        return _rolling(self.word_hashes(1), phrase, _MUL[0])

    def window_hashes(self) -> np.ndarray:
        return _rolling(self.word_hashes(2), self._window, _MUL[1])

    def elected(self, hashes: np.ndarray, phrase: int = PHRASE) -> np.ndarray:
        """The place of each window's least phrase, the leftmost on ties."""
        anchor = self.at.copy()
        if len(self.at):
            least = hashes[self.at]
            for k in range(1, self._window - phrase + 1):
                other = hashes[self.at + k]
                better = other < least
                least[better] = other[better]
                anchor[better] = self.at[better] + k
        return anchor


def _compress(texts: list[str | None]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _texts(packed: bytes) -> pa.Array:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)) as reader:
        return reader.read_all().column(0).combine_chunks()


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: block, ids (longs; nulls kept), n_words, texts (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            name = uuid.uuid4().int & _LAST
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([_compress(texts)], pa.binary())],
                names=["block", "ids", "texts"],
            )

        for batch in batches:
            for part in slices(batch, most=block_bytes):
                size = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if ids and held + size > block_bytes:
                    yield block()
                    ids, texts, held = [], [], 0
                ids += part.column(0).to_pylist()
                texts += part.column(1).to_pylist()
                held += size
        if ids:
            yield block()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, ids array<long>, texts binary")


def _anchors(n_buckets: int, window: int, phrase: int):
    """Per block and bucket: the different elected phrases (hash, one place, whether it occurs again in the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(_texts(packed.as_py()), window)
                hashes = block.phrase_hashes(phrase)
                place = np.unique(block.elected(hashes, phrase))
                found, first, count = np.unique(hashes[place], return_index=True, return_counts=True)
                bucket = (found >> np.uint64(20)) % np.uint64(n_buckets)
                order = np.argsort(bucket, kind="stable")
                found, again, bucket = found[order], (count > 1)[order], bucket[order]
                where = place[first][order].astype(np.int32)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                heads = np.concatenate(([0], cut)) if len(bucket) else cut
                tails = np.append(cut, len(bucket)) if len(bucket) else cut
                split = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[heads].astype(np.int32)),
                        pa.array([name] * len(heads), pa.int64()),
                        split(found),
                        split(where),
                        split(again),
                    ],
                    names=["bucket", "block", "hashes", "places", "again"],
                )

    return run


def _known(table: pa.Table) -> pa.Table:
    """The different phrases of one group of blocks in a bucket, and whether each occurs again among them."""
    hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")])
    again = np.concatenate([np.frombuffer(x.as_py(), bool) for x in table.column("again")])
    found, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    repeated = count > 1
    repeated[inverse[again]] = True
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "hashes": pa.array([found.tobytes()], pa.binary()), "again": pa.array([repeated.tobytes()], pa.binary())})


def _recurring(table: pa.Table) -> pa.Table:
    """The phrases of a bucket that occur more than once."""
    out = _known(table)
    found, again = np.frombuffer(out.column("hashes")[0].as_py(), np.uint64), np.frombuffer(out.column("again")[0].as_py(), bool)
    return pa.table({"bucket": out.column("bucket"), "known": pa.array([found[again].tobytes()], pa.binary())})


def _keep_recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, hashes, places) of (block, hashes, places, known): those among the known ones, which are sorted."""
    for batch in batches:
        blocks, kept, where = [], [], []
        last, known = None, np.zeros(0, np.uint64)
        for block, hashes, places, text in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
            raw = text.as_py()
            if raw is not last and raw != last:
                last, known = raw, np.frombuffer(raw, np.uint64)
            h = np.frombuffer(hashes.as_py(), np.uint64)
            at = np.searchsorted(known, h)
            own = np.zeros(len(h), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == h
            if own.any():
                blocks.append(block)
                kept.append(h[own].tobytes())
                where.append(np.frombuffer(places.as_py(), np.int32)[own].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(kept, pa.binary()), pa.array(where, pa.binary())], names=["block", "hashes", "places"])


def _confirm(table: pa.Table) -> pa.Table:
    """Of a bucket's phrases, those that occur more than once, for each block that has them."""
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    again = np.concatenate([np.frombuffer(x.as_py(), bool) for x in table.column("again")])
    found, inverse, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    recurs = (count > 1)[inverse]
    recurs |= np.isin(inverse, inverse[again])
    kept, places, at = [], [], 0
    for h, place in zip(hashes, table.column("places"), strict=True):
        own = recurs[at : at + len(h)]
        kept.append(h[own].tobytes())
        places.append(np.frombuffer(place.as_py(), np.int32)[own].tobytes())
        at += len(h)
    kept, places = pa.array(kept, pa.binary()), pa.array(places, pa.binary())
    out = pa.table({"block": table.column("block"), "hashes": kept, "places": places})
    return out.filter(pc.greater(pc.binary_length(out.column("hashes")), 0))


def confirmed(anchors: DataFrame, groups: int) -> DataFrame:
    """(block, hashes, places) of the phrases that occur again.

    With many blocks a phrase that most of them hold would bring one record from each to one bucket; so groups of blocks first
    state what they know, a bucket gathers one statement of each group, and the blocks' own lists meet the answer in a
    join that can be split.
    """
    if groups == 1:
        return anchors.groupBy("bucket").applyInArrow(_confirm, "block long, hashes binary, places binary")
    salted = anchors.withColumn("salt", F.pmod("block", F.lit(groups)).cast("int"))
    kind = "bucket int, hashes binary, again binary"
    stated = salted.select("bucket", "salt", "hashes", "again").groupBy("bucket", "salt").applyInArrow(_known, kind)
    known = stated.groupBy("bucket").applyInArrow(_recurring, "bucket int, known binary").filter(F.length("known") > 0)
    both = anchors.select("bucket", "block", "hashes", "places").join(known.hint("shuffle_hash"), "bucket")
    return both.select("block", "hashes", "places", "known").mapInArrow(_keep_recurring, "block long, hashes binary, places binary")


def joined(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Runs of words of these sizes, each joined by single blanks."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ")


def phrase_hits(block: Block, places: np.ndarray, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Every place in the block where one of the phrases at `places` stands, and which one (its index in places).

    The phrases are compiled into an automaton, and the documents of the block stream through it.
    """
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = places.astype(np.int64)
    own = block.words.take(pa.array((places[:, None] + np.arange(phrase)).ravel()))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, text in enumerate(joined(own, np.full(len(places), phrase)).to_pylist()):
        automaton.add_word(f" {text} ", k)
    automaton.make_automaton()
    lengths = pc.utf8_length(block.words).to_numpy(zero_copy_only=False).astype(np.int64)
    blanks = np.concatenate(([0], np.cumsum(lengths + 1)))
    at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, e, text in zip(block.starts.tolist(), block.ends.tolist(), joined(block.words, block.sizes).to_pylist(), strict=True):
        if e - s < phrase:
            continue
        found = list(automaton.iter(f" {text} "))
        if found:
            ends, index = np.array(found, np.int64).T
            # A match ends with the blank after its last word.
            at.append(np.searchsorted(blanks, ends + blanks[s]) - phrase)
            which.append(index)
    return np.concatenate(at), np.concatenate(which)


def candidates(block: Block, hits: np.ndarray, names: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (indices into block.at) that hold a hit, and the least name among their hits."""
    n = len(block.words)
    name = np.full(n + span, _NONE)
    name[hits] = names
    before = np.concatenate(([0], np.cumsum(name != _NONE)))
    chosen = np.flatnonzero(before[block.at + span] > before[block.at])
    at = block.at[chosen]
    least = name[at]
    for k in range(1, span):
        np.minimum(least, name[at + k], out=least)
    return chosen, least


def _ranges(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged ranges covered by windows at sorted starts."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return starts[np.concatenate(([0], cut))], starts[np.append(cut, len(starts)) - 1] + width


def _encode(a: np.ndarray, b: np.ndarray, d: np.ndarray, s: np.ndarray, at: np.ndarray) -> bytes:
    """Windows of one block in the order of place. Runs around one phrase occurrence hold name, id and place once, then the
    hashes of their windows."""
    head = np.ones(len(at), bool)
    head[1:] = (np.diff(at) != 1) | (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    runs = np.flatnonzero(head)
    return b"".join((
        np.array([len(runs), len(at)], np.int64).tobytes(), a[runs].tobytes(), d[runs].astype(np.int64).tobytes(), s[runs].astype(np.int32).tobytes(),
        at[runs].astype(np.int32).tobytes(), np.diff(np.append(runs, len(at))).astype(np.int32).tobytes(), b.tobytes(),
    ))


def _decode(payload: bytes) -> tuple[np.ndarray, ...]:
    """(a, b, d, s, at) of _encode."""
    r, n = np.frombuffer(payload, np.int64, 2)
    place, fields = 16, []
    for kind, length in ((np.uint64, r), (np.int64, r), (np.int32, r), (np.int32, r), (np.int32, r), (np.uint64, n)):
        fields.append(np.frombuffer(payload, kind, length, place))
        place += fields[-1].nbytes
    a, d, s, at, count, b = fields
    step = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(a, count), b, np.repeat(d, count), np.repeat(s, count) + step, np.repeat(at, count) + step


def _windows(n_buckets: int, window: int, phrase: int):
    """Per block: first occurrences of its recurring windows by bucket, and ranges settled inside the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, ids, packed, hashes, places = (batch.column(k)[row].as_py() for k in range(5))
                hashes = np.concatenate([np.frombuffer(h, np.uint64) for h in hashes])
                places = np.concatenate([np.frombuffer(p, np.int32) for p in places])
                block = Block(_texts(packed), window)
                hits, which = phrase_hits(block, places, phrase)
                chosen, key_a = candidates(block, hits, hashes[which], window - phrase + 1)
                at, doc = block.at[chosen], block.doc[chosen]
                key_b = block.window_hashes()[at] if len(at) else key_a
                doc_id = np.array([_LAST if i is None else i for i in ids], np.int64)[doc]
                start = (at - block.starts[doc]).astype(np.int64)
                order = np.lexsort((start, doc_id, key_b, key_a))
                a, b, d, s = key_a[order], key_b[order], doc_id[order], start[order]
                new = np.ones(len(order), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                group = np.cumsum(new) - 1
                lead = np.flatnonzero(new)[group] if len(order) else group
                later = (d != d[lead]) | (s != s[lead])
                out = [[], [], [], []]
                settled = np.sort(at[order[later]])
                lo, hi = _ranges(settled, window)
                if len(lo):
                    for column, value in zip(out, (int(name % n_buckets), name, 1, np.stack([lo, hi]).tobytes()), strict=True):
                        column.append(value)
                first = np.sort(order[~later])
                bucket = (key_a[first] >> np.uint64(20)) % np.uint64(n_buckets)
                first = first[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                for part in np.split(first, cut) if len(first) else []:
                    payload = _encode(key_a[part], key_b[part], doc_id[part], start[part], at[part])
                    where = int((key_a[part[0]] >> np.uint64(20)) % np.uint64(n_buckets))
                    for column, value in zip(out, (where, name, 0, payload), strict=True):
                        column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                    names=["bucket", "block", "settled", "payload"],
                )

    return run


def _sorted_out(payloads: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """All windows of some payloads in the order (window, id, start), the payload of each, and which are not the first."""
    parts = [_decode(p) for p in payloads]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    a, b, d, s, at = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.lexsort((s, d, b, a))
    a, b, d, s, at, owner = (x[order] for x in (a, b, d, s, at, owner))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    return [a, b, d, s, at], owner, (d != d[lead]) | (s != s[lead])


def _firsts(window: int, last: bool):
    """Word ranges, by block, of windows that are not the earliest of their group; settled ranges pass through.

    last: all of a bucket's windows are here. Otherwise a group's earliest windows go on to the next level.
    """

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        blocks, payloads = [], []
        for block, settled, payload in zip(*(table.column(c).to_pylist() for c in ("block", "settled", "payload")), strict=True):
            if settled:
                out.append((block, 1, payload))
            else:
                blocks.append(block)
                payloads.append(payload)
        if payloads:
            fields, owner, later = _sorted_out(payloads)
            by_place = np.lexsort((fields[4], owner))
            owner, later, fields = owner[by_place], later[by_place], [f[by_place] for f in fields]
            for k, (lo, hi) in enumerate(zip(*(np.searchsorted(owner, np.arange(len(blocks)), side) for side in ("left", "right")), strict=True)):
                own = later[lo:hi]
                ranges = _ranges(fields[4][lo:hi][own], window)
                if len(ranges[0]):
                    out.append((blocks[k], 1, np.stack(ranges).astype(np.int64).tobytes()))
                if not last and not own.all():
                    out.append((blocks[k], 0, _encode(*(f[lo:hi][~own] for f in fields))))
        columns = {"block": pa.array([o[0] for o in out], pa.int64()), "settled": pa.array([o[1] for o in out], pa.int32()), "payload": pa.array([o[2] for o in out], pa.binary())}
        if not last:
            columns = {"bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int32()), **columns}
        return pa.table(columns)

    return run


def later_ranges(found: DataFrame, window: int, groups: int) -> DataFrame:
    """(block, ranges): words of windows that are not the earliest; in two levels where there are many blocks, as in
    `confirmed`, so that a bucket receives one record of each group for a window that most blocks hold."""
    if groups > 1:
        salted = found.withColumn("salt", F.pmod("block", F.lit(groups)).cast("int"))
        found = salted.groupBy("bucket", "salt").applyInArrow(_firsts(window, False), "bucket int, block long, settled int, payload binary")
        settled = found.filter("settled = 1").select("block", F.col("payload").alias("ranges"))
        found = found.filter("settled = 0")
    out = found.groupBy("bucket").applyInArrow(_firsts(window, True), "block long, settled int, payload binary")
    out = out.select("block", F.col("payload").alias("ranges"))
    return out.unionByName(settled) if groups > 1 else out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            ids, packed, ranges = (batch.column(k)[row].as_py() for k in range(3))
            words, sizes = ascii_words(_texts(packed))
            edge = np.zeros(len(words) + 1, np.int64)
            for r in ranges or []:
                lo, hi = np.frombuffer(r, np.int64).reshape(2, -1)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
            gone = np.cumsum(edge)[:-1] > 0
            ends = np.cumsum(sizes)
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[ends] - total[ends - sizes]
            texts = joined(words.filter(pa.array(~gone)), sizes - removed)
            digests = [hashlib.sha256(t or b"").hexdigest() for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    texts,
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, bucket_rows: int = BUCKET_ROWS,
                   block_bytes: int = BLOCK_BYTES, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of docs.

    Ids that are no integers are numbered in their order first and put back at the end.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        names = written(ranked(docs.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "_n"), "names")
        numbered = docs.select("doc_id", "text").join(names, "doc_id", "left").select(F.col("_n").alias("doc_id"), "text")
        out = remove_repeats(numbered, window, phrase, bucket_rows, block_bytes, group_blocks).withColumnRenamed("doc_id", "_n")
        return out.join(names, "_n", "left").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = written(pack(docs, block_bytes), "blocks")
    packed, n_blocks = blocks.agg(F.coalesce(F.sum(F.length("texts")), F.lit(0)), F.count("*")).first()
    groups = int(max(1, -(-n_blocks // group_blocks)))
    # About four bytes of compressed text for a word; buckets hold a bounded number of windows however many there are.
    n_buckets = int(max(1, packed // (4 * bucket_rows)))
    anchors = blocks.select("block", "texts").mapInArrow(
        _anchors(n_buckets, window, phrase), "bucket int, block long, hashes binary, places binary, again binary"
    )
    recurring = confirmed(anchors, groups)
    both = recurring.groupBy("block").agg(F.collect_list(F.struct("hashes", "places")).alias("r"))
    by_block = both.select("block", F.col("r.hashes").alias("hashes"), F.col("r.places").alias("places"))
    found = blocks.join(by_block, "block").select("block", "ids", "texts", "hashes", "places").mapInArrow(
        _windows(n_buckets, window, phrase), "bucket int, block long, settled int, payload binary"
    )
    ranges = later_ranges(found, window, groups).groupBy("block").agg(F.collect_list("ranges").alias("ranges"))
    return blocks.join(ranges, "block", "left").select("ids", "texts", "ranges").mapInArrow(
        _remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
