"""Language-model scores by online logistic context mixing.

A lower-cased text plus an end symbol is a sequence of bytes, each coded by a few binary choices: its path through
the Huffman tree of the byte before it. Every choice is predicted by several hashed contexts (the last 2, 3 and 5
bytes, and the word begun so far), whose tables hold how the training texts chose there. The predictions meet in the
logistic domain: weights selected by a gate (depth in the tree, which contexts have evidence), plus a refinement that
each document starts at zero and updates online after FIRST_BLOCK choices and at every doubling until the blocks have
BLOCK choices, so a choice is only ever predicted from
what comes before it.

The hashed tables have a fixed size, so one more predictor holds what grows with the corpus: the exact counts of all
training words. Each word's probability is (1 - share) times that of its bytes plus share times its part of all
training words (a place between two separators without a word costs 1 - share), and the document's probability is the
even mixture over SHARES, so each document finds its own share as it goes. Its logarithm is the score; divided by
the bytes it gives bits per byte.

Passes: one gathers word counts and byte pairs, one the events of all training texts (a byte, the 5 before it and the
word begun: what its choices and their slots depend on), which each task stores once with the number of times they
occurred. Two read those events: one fills the tables (tasks send compressed counts, summed in two streaming rounds
that hold a fixed amount of memory and end as log odds in single bytes), one fits the gated weights with each choice's
own count taken out, every choice weighing as often as it occurred (every partition starts from weights of a bounded
sample; their means by gate are used). The last pass scores. The tables and the most frequent words (at most HEAD, of at most HEAD_CHARS characters) are
broadcast; the other words meet their counts in a join. Texts of any length are read whole, in slices.

Defined results: null text is empty, so its only token is the end; rows with a null id belong to the training part;
with no training rows all tables are empty and counts are 0. Repeated rows are trained on as often as they occur and
scored each for itself, with equal results.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ROW, fold, row_keyed, written
from corvane.llm.token_count import ascii_words, slices

ORDERS, TABLE_BITS, CHUNK_BITS = (2, 3, 5), 21, 16
N_CONTEXTS = len(ORDERS) + 1
BLOCK, FIRST_BLOCK, LEARN_BLOCK, GATES, REFINE = 4096, 64, 8192, 16, 2e-4
SHORT = 1024
HEAD, HEAD_CHARS, FLUSH_WORDS = 250_000, 100, 250_000
EVENT_BYTES, MOST_EVENTS, EVENT_ROW, TASK_CHOICES = 1 << 20, 1_500_000, 250_000, 1 << 31
SAMPLE_DOCS, SAMPLE_CHARS, EPOCHS = 400, 2000, 4
SHARES = (0.0, 0.02, 0.1, 0.3)
SCORE_BYTES, SLICE_BYTES, PAVED, PAD, END = 4 << 20, 256 << 10, 128 << 10, 8, 0xFF
_SCALE = 16.0
_WORD_STEP = 0x9E3779B1


def huffman(counts: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """For each of the 256 symbols the inner nodes on its path and the choices there."""
    heap = [(int(c), s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children, name = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[name] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], name, name))
        name += 1
    nodes: list[list[int]] = [[] for _ in range(256)]
    bits: list[list[int]] = [[] for _ in range(256)]
    stack = [(heap[0][2], [], [])]
    while stack:
        at, path, turns = stack.pop()
        if at < 256:
            nodes[at], bits[at] = path, turns
            continue
        for bit, child in enumerate(children[at]):
            stack.append((child, [*path, at - 256], [*turns, bit]))
    return nodes, bits


class Paths:
    """Choices of every (byte before, byte): start and length in a flat array of turns."""

    def __init__(self, pairs: np.ndarray):
        overall = pairs.sum(axis=0)
        nodes, bits, depths, known, at = [], [], [], {}, 0
        start, size = np.zeros(65536, np.int32), np.zeros(65536, np.uint8)
        for before in range(256):
            own = pairs[before].sum() > 0
            # A byte that was never followed by anything shares one tree.
            if own or None not in known:
                weights = pairs[before] * 4096 + (overall * 64 // max(1, int(overall.sum() // 4096 + 1))) + 1
                known[before if own else None] = at
                for symbol, (path, turns) in enumerate(zip(*huffman(weights), strict=True)):
                    start[before * 256 + symbol], size[before * 256 + symbol] = at, len(path)
                    nodes += path
                    bits += turns
                    depths += [min(k, 3) for k in range(len(path))]
                    at += len(path)
                if not own:
                    shared = slice(before * 256, before * 256 + 256)
            else:
                start[before * 256 : before * 256 + 256], size[before * 256 : before * 256 + 256] = start[shared], size[shared]
        # Hash of the node, and in its low three bits the depth (up to 3) and the choice.
        self.turns = _spread(np.array(nodes, np.uint32) * np.uint32(0x85EBCA6B)) & np.uint32(0xFFFFFFF8)
        self.turns |= np.array(depths, np.uint32) * np.uint32(2) + np.array(bits, np.uint32)
        self.start, self.size = start, size


def _spread(h: np.ndarray) -> np.ndarray:
    """32-bit hashes with every input bit spread over all bits."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32, END]] = True


def spelled(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For every byte of some texts, ends included: it and the 5 bytes before it in 48 bits, the hash of the word begun
    before it, and its length of text by text; what stands before a text is zeros."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    gap = bytes(PAD)
    parts = [x for t in texts for x in (gap, t, b"\xff")]
    data = _LOWER.take(np.frombuffer(b"".join([*parts, gap]), np.uint8))
    n = len(data) - PAD
    real = np.ones(n, bool)
    heads = np.cumsum(sizes + PAD) - sizes - PAD
    real[(heads[:, None] + np.arange(PAD)).ravel()] = False
    # Eight bytes from each place, read as one little-endian number.
    back = max(ORDERS)
    wide = np.ndarray((n - back,), "<u8", data, 0, (1,))[real[back:]] & np.uint64((1 << 8 * (back + 1)) - 1)
    # Hash of the bytes since the last white space: differences of a running polynomial.
    terms = data[:n].astype(np.uint32)
    terms += np.uint32(1)
    terms *= _powers(n)
    total = np.zeros(n + 1, np.uint32)
    np.cumsum(terms, out=total[1:])
    begin = np.zeros(n, np.int32)
    spaces = np.flatnonzero(_SPACE.take(data[: n - 1]))
    begin[spaces + 1] = spaces + 1
    np.maximum.accumulate(begin, out=begin)
    word = total[:n] - total.take(begin)
    word *= _inverse_powers(n).take(begin)
    return wide, word[real], sizes


def together(wide: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal bytes in equal contexts together, and the places in it where another one starts."""
    h = (wide * np.uint64(0x9E3779B97F4A7C15)) ^ (word * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # Places ride in the low bits, so a plain sort will do; where two hashes agree in the others, runs are split.
    low = np.uint64((1 << len(h).bit_length()) - 1)
    h &= ~low
    h |= np.arange(len(h), dtype=np.uint64)
    h.sort()
    h &= low
    order = h.view(np.int64)
    a, b = wide.take(order), word.take(order)
    fresh = np.ones(len(h), bool)
    np.not_equal(a[1:], a[:-1], out=fresh[1:])
    fresh[1:] |= b[1:] != b[:-1]
    return order, np.flatnonzero(fresh)


class Events:
    """Distinct bytes in their contexts with how often each occurred; grows by texts, holds about `most` of them."""

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, wide: np.ndarray, word: np.ndarray, n: np.ndarray | None = None) -> None:
        order, starts = together(wide, word)
        at = order.take(starts)
        if n is None:
            n = np.diff(starts, append=len(order))
        elif len(order):
            n = np.add.reduceat(n.take(order), starts)
        self.parts.append((wide.take(at), word.take(at), n))
        self.held += len(at)

    def merge(self) -> bool:
        """Bring equal events together; whether they fill more than three quarters of what may be held."""
        if self.parts:
            whole = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.held = [], 0
            self.add(*whole)
        return 4 * self.held > 3 * self.most

    def rows(self) -> pa.RecordBatch:
        """All held events in pieces of at most EVENT_ROW, each a sample in the order of contexts; none are held after."""
        self.merge()
        wide, word, n = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        order = np.argsort(wide)
        step = -(-len(order) // EVENT_ROW)
        columns = [[], [], []]
        for k in range(step):
            at = order[k::step]
            for c, x in zip(columns, (wide, word, n), strict=True):
                c.append(_squeeze(np.ascontiguousarray(x.take(at).view(np.uint8).reshape(len(at), -1).T)))
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=_EVENTS)


_EVENTS = ["wide", "begun", "times"]
_EVENT_TYPE = "wide binary, begun binary, times binary"


def _unplaned(b: bytes, kind) -> np.ndarray:
    planes = _unsqueeze(b, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Events(MOST_EVENTS)
    for batch in batches:
        for part in slices(batch, 0, EVENT_BYTES):
            found.add(*spelled([(t or "").encode() for t in part.column(0).to_pylist()])[:2])
            if found.held > MOST_EVENTS and found.merge():
                yield found.rows()
    yield found.rows()


def events_of(texts: DataFrame) -> DataFrame:
    """The events of all texts (their first column), counted within each task; texts that are events already stay."""
    return texts if texts.columns == _EVENTS else texts.mapInArrow(_events, _EVENT_TYPE)


def _paved(batches: Iterator[pa.RecordBatch], paths: Paths) -> Iterator[tuple[Paved, np.ndarray]]:
    """Choices of stored events, some at a time, with how often each occurred. In a fixed but mixed order."""
    for batch in batches:
        for wide, word, n in zip(*(batch.column(c).to_pylist() for c in _EVENTS), strict=True):
            wide, word, n = _unplaned(wide, np.uint64), _unplaned(word, np.uint32), _unplaned(n, np.int64)
            order = np.random.default_rng(1).permutation(len(wide))
            for a in range(0, len(order), PAVED):
                at = order[a : a + PAVED]
                made = Paved(wide.take(at), word.take(at), paths)
                yield made, np.repeat(n.take(at), made.size)


class Paved:
    """All binary choices of some bytes in their contexts: table slots of each context, bits and depths."""

    def __init__(self, wide: np.ndarray, word: np.ndarray, paths: Paths):
        far = max(ORDERS)
        contexts = []
        h = np.zeros(len(wide), np.uint32)
        for back in range(1, far + 1):
            h = (h + ((wide >> np.uint64(8 * (far - back))) & np.uint64(255)).astype(np.uint32) + np.uint32(1)) * np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(15)
            if back in ORDERS:
                contexts.append(h)
        contexts.append((word ^ (word >> np.uint32(13))) * np.uint32(0x297A2D39) + np.uint32(77))
        low = (wide >> np.uint64(8 * (far - 1))).astype(np.uint16)
        pair = ((low << np.uint16(8)) | (low >> np.uint16(8))).astype(np.int32)
        self.size = paths.size.take(pair)
        count = np.cumsum(self.size, dtype=np.int32)
        n = int(count[-1]) if len(count) else 0
        self.first = count - self.size
        # The byte of each choice; everything else is looked up through it.
        owner = np.zeros(n, np.int64)
        owner[self.first[1:]] = 1
        np.cumsum(owner, out=owner)
        place = (paths.start.take(pair).astype(np.int64) - self.first).take(owner)
        place += np.arange(n)
        node = paths.turns.take(place)
        low = node.astype(np.uint8)
        self.bits, self.depth = low & np.uint8(1), (low >> np.uint8(1)) & np.uint8(3)
        node &= np.uint32(0xFFFFFFF8)
        shift = np.uint32(32 - TABLE_BITS)
        self.slots = []
        for k, c in enumerate(contexts):
            s = _spread(c + np.uint32(k * 0x51ED270B)).take(owner)
            s += node
            s >>= shift
            self.slots.append(s.view(np.int32))


class Choices(Paved):
    """All binary choices of some texts, one after the other, where texts end in them, and cuts where words start or end
    or texts end: their numbers for each of these."""

    def __init__(self, texts: list[bytes], paths: Paths):
        wide, word, sizes = spelled(texts)
        super().__init__(wide, word, paths)
        ends = np.cumsum(sizes)
        starts = np.append(self.first, len(self.bits)).astype(np.int64)
        self.text_ends = starts[ends]
        stop = _BREAK.take((wide >> np.uint64(8 * max(ORDERS))).astype(np.uint8))
        fresh = np.concatenate(([True], stop[:-1]))[: len(stop)]
        begun, done = np.flatnonzero(~stop & fresh), np.flatnonzero(stop & ~fresh)
        mark = np.zeros(len(stop) + 1, np.int64)
        mark[0] = mark[begun] = mark[done] = mark[ends] = 1
        self.cuts, place = starts[np.flatnonzero(mark[:-1])], np.cumsum(mark) - 1
        self.ends, self.word_starts, self.word_ends = place[ends], place[begun], place[done]
        self.breaks = np.diff(np.concatenate(([0], np.cumsum(stop)[ends - 1])))


_POWERS: dict[str, np.ndarray] = {}


def _grown(name: str, n: int, step: int) -> np.ndarray:
    if len(_POWERS.get(name, ())) < n:
        steps = np.full(max(n, 1 << 18), step, np.uint32)
        steps[0] = 1
        _POWERS[name] = np.cumprod(steps, dtype=np.uint32)
    return _POWERS[name][:n]


def _powers(n: int) -> np.ndarray:
    return _grown("up", n, _WORD_STEP)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("down", n, pow(_WORD_STEP, -1, 1 << 32))


def _long_parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Groups of texts with about SLICE_BYTES together."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > SLICE_BYTES:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unsqueeze(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


_COUNTS = ["key", "place", "n"]
_COUNT_TYPE = "key int, place binary, n binary"
PIECE, PIECES = 2 << CHUNK_BITS, 1 << (TABLE_BITS - CHUNK_BITS)


def _count_rows(tables: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Non-zero counts of dense pieces: places as differences, counts in the fewest bytes."""
    keys, places, counts = [], [], []
    for key, dense in tables.items():
        at = np.flatnonzero(dense)
        if len(at):
            keys.append(key)
            places.append(_squeeze(np.diff(at, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy()))
            counts.append(_squeeze(dense[at].astype(np.uint64).view(np.uint8).reshape(-1, 8).T.copy()))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=_COUNTS
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """Streaming sum of count rows: holds one dense piece for each key of the partition."""
    tables: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, place, n in zip(*(batch.column(c).to_pylist() for c in _COUNTS), strict=True):
            if key not in tables:
                tables[key] = np.zeros(PIECE, np.uint64)
            at = np.cumsum(_unsqueeze(place, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel())
            tables[key][at] += _unsqueeze(n, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return tables


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _count_rows(_summed(batches))


def evidence(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of a one as small integers; zero without counts."""
    odds = np.log((ones + 0.2) / (zeros + 0.2))
    return np.clip(np.rint(odds * _SCALE), -127, 127).astype(np.int8)


def _odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece the evidence by slot, and by (slot, bit) as it is without one choice of that bit."""
    keys, plain, others = [], [], []
    for key, dense in _summed(batches).items():
        zeros, ones = dense[0::2].astype(np.float64), dense[1::2].astype(np.float64)
        without = np.empty(PIECE, np.int8)
        without[0::2] = evidence(np.maximum(zeros - 1, 0), ones)
        without[1::2] = evidence(zeros, np.maximum(ones - 1, 0))
        keys.append(key)
        plain.append(_squeeze(evidence(zeros, ones)))
        others.append(_squeeze(without))
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), pa.array(plain, pa.binary()), pa.array(others, pa.binary())], names=["key", "plain", "others"]
    )


def table_evidence(texts: DataFrame, paths) -> tuple[np.ndarray, np.ndarray]:
    """Evidence (context, slot) of all texts, or of their events, and (context, 2 * slot + bit) without one's own choice.

    Counts are gathered in pieces of a fixed size and leave the executors as one byte a slot, so what reaches the driver has
    a fixed size (at most 3 * 2^TABLE_BITS bytes a context), and no count is cut.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((N_CONTEXTS, 2 << TABLE_BITS), np.uint32)
        total = 0
        for made, n in _paved(batches, paths.value):
            more = int(n.sum())
            if total and total + more > TASK_CHOICES:
                yield _count_rows(dict(enumerate(counts.reshape(-1, PIECE))))
                counts[:] = 0
                total = 0
            total += more
            if more > TASK_CHOICES:
                counts = counts.astype(np.uint64)
            n = n.astype(counts.dtype)
            for c, slot in enumerate(made.slots):
                slot *= np.int32(2)
                slot += made.bits
                np.add.at(counts[c], slot, n)
        yield _count_rows(dict(enumerate(counts.reshape(-1, PIECE))))

    rows = events_of(texts).mapInArrow(fill, _COUNT_TYPE)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    half = rows.repartition(n, "key", F.xxhash64("place") % 4).mapInArrow(_sum_counts, _COUNT_TYPE)
    full = half.repartition("key").mapInArrow(_odds, "key int, plain binary, others binary")
    plain = np.zeros((N_CONTEXTS * PIECES, PIECE // 2), np.int8)
    others = np.zeros((N_CONTEXTS * PIECES, PIECE), np.int8)
    # A row for each of the N_CONTEXTS * PIECES pieces, whatever the input.
    for key, p, o in full.collect():
        plain[key], others[key] = _unsqueeze(bytes(p), np.int8), _unsqueeze(bytes(o), np.int8)
    return plain.reshape(N_CONTEXTS, -1), others.reshape(N_CONTEXTS, -1)


def gates_of(depth: np.ndarray, inputs: list[np.ndarray]) -> np.ndarray:
    return (depth * np.uint8(4) + (inputs[-2] != 0) * np.uint8(2) + (inputs[-1] != 0)).astype(np.int64)


def _stacked(inputs: list[np.ndarray]) -> np.ndarray:
    """Inputs as rows of a float matrix, one row for each context."""
    out = np.empty((len(inputs), len(inputs[0])), np.float32)
    for k, x in enumerate(inputs):
        np.multiply(x, np.float32(1 / _SCALE), out=out[k])
    return out


class Gates:
    """Weights (gate, context) under online gradient steps, and the number of choices each gate has seen."""

    def __init__(self, weights: np.ndarray | None = None, square: np.ndarray | None = None):
        self.weights = np.full((GATES, N_CONTEXTS), 0.4, np.float32) if weights is None else weights.copy()
        self.square = np.full_like(self.weights, 1e-3) if square is None else square.copy()
        self.seen = np.zeros(GATES)

    def learn(self, texts: list[bytes], paths: Paths, others: np.ndarray, epochs: int) -> None:
        made = Choices(texts, paths)
        self.learn_choices(made, np.ones(len(made.bits)), others, epochs)

    def learn_choices(self, made: Paved, n: np.ndarray, others: np.ndarray, epochs: int) -> None:
        """Steps over choices of which each occurred n times, as often as that."""
        inputs = []
        for c, slot in enumerate(made.slots):
            slot *= np.int32(2)
            slot += made.bits
            inputs.append(others[c].take(slot))
        gate, x = gates_of(made.depth, inputs), _stacked(inputs)
        y = made.bits.astype(np.float32)
        n = n.astype(np.float32)
        self.seen += np.bincount(gate, n, GATES)
        for _ in range(epochs):
            for a in range(0, len(y), LEARN_BLOCK):
                part, g = x[:, a : a + LEARN_BLOCK], gate[a : a + LEARN_BLOCK]
                columns = np.ascontiguousarray(self.weights.T)
                z = columns[0].take(g) * part[0]
                for k in range(1, N_CONTEXTS):
                    z += columns[k].take(g) * part[k]
                np.negative(z, out=z)
                np.exp(np.minimum(z, 60, out=z), out=z)
                z += 1
                error = np.reciprocal(z, out=z)
                error -= y[a : a + LEARN_BLOCK]
                error *= n[a : a + LEARN_BLOCK]
                grad = np.stack([np.bincount(g, error * part[k], GATES) for k in range(N_CONTEXTS)], axis=1)
                self.square += grad**2
                self.weights -= (0.05 * grad / np.sqrt(self.square)).astype(np.float32)


def fit_gates(texts: DataFrame, samples: list[bytes], paths, others: np.ndarray) -> np.ndarray:
    """Weights from all training texts: partitions go on from the sample's weights, then the mean by gate counts."""
    first = Gates()
    if samples:
        first.learn(samples, paths.value, others, EPOCHS)
    shared = texts.sparkSession.sparkContext.broadcast((zlib.compress(others.tobytes(), 1), first.weights, first.square))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, weights, square = shared.value
        table = np.frombuffer(zlib.decompress(packed), np.int8).reshape(N_CONTEXTS, -1)
        own = Gates(weights, square)
        for made, n in _paved(batches, paths.value):
            own.learn_choices(made, n, table, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.weights.tobytes()], pa.binary()), pa.array([own.seen.tobytes()], pa.binary())], names=["weights", "seen"]
        )

    total, seen = np.zeros((GATES, N_CONTEXTS)), np.zeros((GATES, 1))
    for weights, n in events_of(texts).mapInArrow(learn, "weights binary, seen binary").collect():  # one small row a partition
        n = np.frombuffer(bytes(n)).reshape(-1, 1)
        total += n * np.frombuffer(bytes(weights), np.float32).reshape(GATES, N_CONTEXTS)
        seen += n
    return np.where(seen > 0, total / np.maximum(seen, 1), first.weights).astype(np.float32)


def _misses(base: np.ndarray, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """exp(z) of every choice, where z is its base and what its text's refinement adds. The inputs x are not scaled."""
    rate = np.float32(REFINE / _SCALE**2)
    starts = np.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    refine = np.zeros((N_CONTEXTS, len(ends)), np.float32)
    out = np.empty(len(base), np.float32)
    a, b = 0, FIRST_BLOCK
    # Short blocks of all texts at once; where a text ends before, its last choice stands again and teaches nothing.
    while b <= SHORT and len(left := np.flatnonzero(sizes > a)):
        at = starts[left, None] + np.arange(a, b)
        inside = at < ends[left, None]
        np.minimum(at, ends[left, None] - 1, out=at)
        z, inputs = base.take(at), [row.take(at) for row in x]
        if a:
            for r, row in zip(refine, inputs, strict=True):
                z += r[left, None] * row
        miss = np.exp(np.minimum(z, 30, out=z), out=z)
        out[at] = miss
        share = inside * miss / (miss + 1)
        for r, row in zip(refine, inputs, strict=True):
            r[left] -= rate * np.einsum("dt,dt->d", share, row)
        a, b = b, b + min(b, BLOCK)
    for i in np.flatnonzero(sizes > a).tolist():
        start, end, r = int(starts[i]), int(ends[i]), refine[:, i].copy()
        stop = start + a
        while stop < end:
            begin, stop = stop, min(stop + min(stop - start, BLOCK), end)
            part, miss = x[:, begin:stop], out[begin:stop]
            np.dot(r, part, out=miss)
            miss += base[begin:stop]
            np.exp(np.minimum(miss, 30, out=miss), out=miss)
            if stop < end:
                share = miss + 1
                r -= rate * (part @ np.divide(miss, share, out=share))
    return out


def log_scores(texts: list[bytes], paths: Paths, tables: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Natural log probability of each text, with its own online refinement of the weights, and its number of
    separators; log probability of each word, text after text."""
    out, breaks, words = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)]
    columns = np.ascontiguousarray(weights.T) * np.float32(1 / _SCALE)
    for group in _long_parts(texts):
        made = Choices(group, paths)
        inputs = [tables[c].take(s.astype(np.int64)) for c, s in enumerate(made.slots)]
        gate = gates_of(made.depth, inputs)
        # Turned so that a choice is lost with probability 1 / (1 + exp(-z)), whichever it was.
        sign = np.int8(1) - np.int8(2) * made.bits.view(np.int8)
        x = np.empty((N_CONTEXTS, len(gate)), np.float32)
        for k, row in enumerate(inputs):
            np.multiply(row, sign, out=row)
            x[k] = row
        base = columns[0].take(gate)
        base *= x[0]
        for k in range(1, N_CONTEXTS):
            more = columns[k].take(gate)
            more *= x[k]
            base += more
        loss = np.log1p(_misses(base, x, made.text_ends))
        so_far = np.concatenate(([0.0], np.cumsum(np.add.reduceat(loss.astype(np.float64), made.cuts))))
        out.append(-np.diff(so_far[made.ends], prepend=0.0))
        words.append(so_far[made.word_starts] - so_far[made.word_ends])
        breaks.append(made.breaks)
    return np.concatenate(out), np.concatenate(breaks), np.concatenate(words)


def _merged(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts (word, n) and byte-pair counts (pair, n) of training texts."""
    empty = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    held, pairs = [empty], np.zeros(65536, np.int64)

    def rows() -> list[pa.RecordBatch]:
        found = _merged(held)
        held[:] = [empty]
        found = pa.table({"word": found["word"], "pair": pa.nulls(len(found), pa.int32()), "n": found["n"]})
        return found.to_batches(max_chunksize=FLUSH_WORDS)

    for batch in batches:
        for part in slices(batch, column=0):
            texts = pc.ascii_lower(part.column(0))
            coded = ascii_words(texts)[0].dictionary_encode()
            if len(coded):
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                held.append(pa.table({"word": coded.dictionary.cast(pa.string()), "n": n}))
            data = np.frombuffer(b"".join(x for t in texts.to_pylist() for x in (b"\0", (t or "").encode(), b"\xff")), np.uint8)
            both = data[:-1].astype(np.uint16)
            both <<= np.uint16(8)
            both |= data[1:]
            pairs += np.bincount(both, minlength=65536)
            if sum(map(len, held)) > FLUSH_WORDS:
                held[:] = [_merged(held)]
                if 2 * len(held[0]) > FLUSH_WORDS:
                    yield from rows()
    yield from rows()
    # The worker goes on to other tasks.
    pa.default_memory_pool().release_unused()
    at = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(pairs[at])], names=["word", "pair", "n"]
    )


def score_texts(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row."""
    spark = docs.sparkSession
    read = row_keyed(docs.select("doc_id", "text"))
    read = read.withColumn("held_out", fold(F.col("doc_id"), folds) == 0)
    train = read.filter("not held_out")
    gathered = train.select("text").mapInArrow(_gather, "word string, pair int, n long")
    counts = written(gathered.groupBy("word", "pair").agg(F.sum("n").alias("c")), "word_counts")
    pairs = np.zeros(65536, np.int64)
    for pair, n in counts.filter("pair is not null").select("pair", "c").collect():  # at most 65,536 rows
        pairs[pair] = n
    paths = spark.sparkContext.broadcast(Paths(pairs.reshape(256, 256)))
    words = counts.filter("word is not null").select("word", "c")
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_ends = train.count()
    n_train, distinct = n_words + n_ends, distinct + (n_ends > 0)
    # The least count that leaves at most HEAD words; counts fall in some thousand classes, an eighth of a bit each.
    classes = words.groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    bar, room_left = n_words + 1, HEAD
    for _, n, least in sorted(classes, reverse=True):
        room_left -= n
        if room_left < 0:
            break
        bar = least
    often = words.filter((F.col("c") >= bar) & (F.length("word") <= HEAD_CHARS))
    head = often.collect()
    # One more count, 0, for words that are none of these.
    head = (pa.array([r[0] for r in head], pa.string()), np.array([*(r[1] for r in head), 0], np.int64))
    events = written(events_of(train.select("text")), "events")
    tables, others = table_evidence(events, paths)
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    spot = F.pmod(F.xxhash64(F.lit(5), "doc_id"), room).cast("int") + 1
    sample = (
        train.filter(F.col("text") != "")
        .select(F.xxhash64("doc_id").alias("h"), F.substring(F.col("text"), spot, F.lit(SAMPLE_CHARS)).alias("w"))
        .orderBy("h", "w").limit(SAMPLE_DOCS).collect()
    )
    weights = fit_gates(events, [r["w"].encode() for r in sample], paths, others)
    shared = spark.sparkContext.broadcast((zlib.compress(tables.tobytes(), 1), weights, head, n_ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, gates, (known, often), ends = shared.value
        table = np.frombuffer(zlib.decompress(packed), np.int8).reshape(N_CONTEXTS, -1)
        for batch in batches:
            for part in slices(batch, 1, SCORE_BYTES):
                n = part.num_rows
                lower = pc.ascii_lower(part.column(1))
                texts = [(t or "").encode() for t in lower.to_pylist()]
                score, breaks, in_bytes = log_scores(texts, paths.value, table, gates)
                found, sizes = ascii_words(lower)
                coded = found.dictionary_encode()
                c = often.take(pc.index_in(coded.dictionary.cast(pa.string()), value_set=known).fill_null(len(known)).to_numpy())
                codes = coded.indices.to_numpy()
                owner = np.repeat(np.arange(n), sizes)
                each = c.take(codes)
                logs = np.bincount(owner, np.where(each > 0, np.log10(each + 0.1), 0), n) + np.log10(ends + 0.1)
                seen = np.bincount(owner, each > 0, n).astype(np.int64) + (ends > 0)
                # The other words of each text, with the log probability of their bytes.
                rest = each == 0
                rare = coded.dictionary.take(pa.array(codes[rest])).cast(pa.string())
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner[rest], minlength=n)))).astype(np.int32))
                lone = score - np.bincount(owner[~rest], in_bytes[~rest], n) - np.bincount(owner[rest], in_bytes[rest], n)
                parts = np.empty((n, len(SHARES)))
                for k, share in enumerate(SHARES):
                    if share == 0:
                        parts[:, k] = score
                        continue
                    mixed = np.logaddexp(np.log1p(-share) + in_bytes[~rest], np.log(share / n_words) + np.log(each[~rest]))
                    parts[:, k] = lone + (breaks - sizes) * np.log1p(-share) + np.bincount(owner[~rest], mixed, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), part.column(3),
                        pa.array(sizes + 1, pa.int64()), pa.array(seen), pa.array(logs), pa.array(list(parts), pa.list_(pa.float64())),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(offsets, rare), pa.ListArray.from_arrays(offsets, pa.array(in_bytes[rest].astype(np.float32))),
                    ],
                    names=["doc_id", "held_out", ROW, "n_tokens", "seen", "logs", "parts", "n_bytes", "rare", "in_bytes"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(
        read.select("doc_id", "text", "held_out", ROW).mapInArrow(
            run,
            f"doc_id {kind}, held_out boolean, {ROW} struct<file:long,at:long>, n_tokens long, seen long, logs double, parts array<double>, "
            "n_bytes long, rare array<string>, in_bytes array<float>",
        ),
        "scored",
    )
    rare = rows.select(ROW, F.explode(F.arrays_zip("rare", "in_bytes")).alias("r"))
    rare = rare.select(ROW, F.col("r.rare").alias("word"), F.col("r.in_bytes").cast("double").alias("in_bytes"))
    c = F.coalesce(F.col("c"), F.lit(0))
    mixed = []
    for k, share in enumerate(SHARES):
        if share:
            x, y = F.col("in_bytes") + float(np.log1p(-share)), F.log("c") + float(np.log(share / max(n_words, 1)))
            both = F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
            mixed.append(F.sum(F.when(c > 0, both).otherwise(x)).alias(f"more_{k}"))
    per_row = (
        rare.join(words, "word", "left")
        .groupBy(ROW)
        .agg(
            F.sum(F.log10(c + 0.1)).alias("more"),
            F.sum(F.when(c > 0, 1).otherwise(0)).alias("more_seen"),
            *mixed,
        )
    )
    logs = [F.col("parts")[k] + (F.coalesce(f"more_{k}", F.lit(0.0)) if share else 0.0) for k, share in enumerate(SHARES)]
    top = F.greatest(*logs)
    score = (top + F.log(sum(F.exp(x - top) for x in logs)) - float(np.log(len(SHARES)))) / float(np.log(10))
    divisor = float(np.log10(n_train + 0.1 * (distinct + 1)))
    found = rows.drop("rare", "in_bytes").join(per_row, ROW, "left").withColumn("score", score)
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("more_seen", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * divisor).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
