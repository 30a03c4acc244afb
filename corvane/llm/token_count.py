"""Token counts of a word-level BPE vocabulary by rank-synchronous array merging.

Pre-tokens never cross ASCII white space, so texts are split there by Arrow, words become dictionary codes, and
only different words are tokenized. Their pre-tokens are held as one ragged numpy array; in each round every
sequence that still has a mergeable pair applies its lowest-rank pair at all places at once (left to right where
they overlap), and finished sequences leave. What counts is the number of symbols that survive. Very long
pre-tokens, where rounds would cost too much, go through a heap with the same result.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as one token
each, as the library's default has it; symbols outside the vocabulary count nothing, as there is no unknown token. Each row is counted
for itself, so repeated rows get equal counts; a text of any length is counted whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from corvane.llm.common import default_tokenizer

LIMIT = 2048
CACHE_WORDS, LONG_SYMBOLS, SLICE_BYTES = 200_000, 1024, 2 << 20
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (printable Latin-1 stays, the rest from 256 up)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary file's normalization, pre-tokens and merges."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_alphabet()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.final = np.array([vocab.get(c + end, -1) for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = np.int64(max(vocab.values()) + 1)
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), merged
        self.lookup = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        whole = Tokenizer.from_str(definition)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(letters)}
        # A text's special strings first, then ordinary stretches.
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def plain(self, part: str) -> list[bytes]:
        """Pre-tokens of a stretch without special strings.

        Letter classes, composition and lower case of ASCII are the same in every Unicode version. For anything else the
        library's own normalizer and splitter are asked, so that its version decides; they give the byte stand-ins.
        """
        if part.isascii():
            return [t.encode() for t in self.pattern.findall(part.lower())]
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))
        return [bytes(map(self.byte_of.__getitem__, t)) for t, _ in pieces]

    def pretokens(self, word: str) -> tuple[list[bytes], int]:
        """Pre-tokens of a word, and how many special strings it holds."""
        if self.special is not None and (n := len(self.special.findall(word))):
            parts = self.special.split(word)
        else:
            parts, n = [word], 0
        return [t for p in parts if p for t in self.plain(p)], n

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def heap_count(self, symbols: list[int]) -> int:
        """Surviving symbols of one long sequence: a heap of (rank, place) over a linked list."""
        n = len(symbols)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        base = int(self.base)
        heap = [
            (r, i) for i in range(n - 1) if (r := self.lookup.get(symbols[i] * base + symbols[i + 1])) is not None
        ]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or self.lookup.get(symbols[i] * base + symbols[j]) != r:
                continue
            symbols[i], alive[j], nxt[i] = int(self.merged[r]), False, nxt[j]
            left -= 1
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := self.lookup.get(symbols[i] * base + symbols[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if prv[i] >= 0 and (r := self.lookup.get(symbols[prv[i]] * base + symbols[i])) is not None:
                heapq.heappush(heap, (r, prv[i]))
        return left

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        if not tokens:
            return out
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        data = np.frombuffer(b"".join(tokens), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        known = symbols >= 0
        symbols, owner = symbols[known], owner[known]
        sizes = np.bincount(owner, minlength=len(tokens))
        for k in np.flatnonzero(sizes > LONG_SYMBOLS):
            out[k] = self.heap_count(symbols[owner == k].tolist())
        short = sizes[owner] <= LONG_SYMBOLS
        symbols, owner = symbols[short], owner[short]
        while len(symbols):
            joined = owner[:-1] == owner[1:]
            rank = np.full(len(symbols), _NONE, np.int32)
            rank[:-1][joined] = self.rank_of(symbols[:-1][joined] * self.base + symbols[1:][joined])
            first = np.flatnonzero(np.concatenate(([True], ~joined)))
            length = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(rank, first)
            done = best == _NONE
            out[owner[first[done]]] = length[done]
            goes_on = np.repeat(~done, length)
            place = np.flatnonzero(goes_on & (rank == np.repeat(best, length)))
            # Of places that follow one another (equal symbols), every second one.
            run = np.concatenate(([True], np.diff(place) != 1)) if len(place) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0)) if len(place) else place
            place = place[(np.arange(len(place)) - start) % 2 == 0]
            symbols[place] = self.merged[rank[place]]
            goes_on[place + 1] = False
            symbols, owner = symbols[goes_on], owner[goes_on]
        return out

    def word_counts(self, words: list[str]) -> np.ndarray:
        tokens, owner = [], []
        out = np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            own, out[i] = self.pretokens(word)
            tokens += own
            owner += [i] * len(own)
        return out + np.bincount(np.array(owner, np.int64), self.counts(tokens), len(words)).astype(np.int64)


def slices(batch: pa.RecordBatch, column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; a longer text stands alone."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    start, held = 0, 0.0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0.0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, and the number of each text's words."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    mask = full.to_numpy(zero_copy_only=False)
    return words.filter(full), np.bincount(owner[mask], minlength=len(texts))


def count_tokens(docs: DataFrame, definition: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; definition: the vocabulary file's content."""
    spark: SparkSession = docs.sparkSession
    if definition is None:
        with open(default_tokenizer("word_bpe_49k.json"), encoding="utf-8") as file:
            definition = file.read()
    shared = spark.sparkContext.broadcast(definition)  # one vocabulary file: its size does not follow the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = WordBpe(shared.value), {}
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1)
                words, sizes = ascii_words(texts)
                coded = words.dictionary_encode()
                names = coded.dictionary.to_pylist()
                counts = np.fromiter((cache.get(w, -1) for w in names), np.int64, len(names))
                if len(misses := np.flatnonzero(counts < 0)):
                    new = [names[i] for i in misses]
                    counts[misses] = bpe.word_counts(new)
                    if len(cache) + len(new) > CACHE_WORDS:
                        cache.clear()
                    cache.update((w, int(c)) for w, c in zip(new, counts[misses], strict=True) if len(w) < 64)
                each = counts[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
                total = np.concatenate(([0], np.cumsum(each)))
                ends = np.cumsum(sizes)
                n_tokens = total[ends] - total[ends - sizes]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pc.binary_length(texts).fill_null(0).cast(pa.int64()),
                        pa.array(n_tokens, pa.int64()),
                        pa.array(n_tokens > limit, pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
