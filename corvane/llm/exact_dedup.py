"""Exact dedup by content-defined chunk recipes.

Each text is cut at content-defined places (a gear hash over the last 32 bytes), each chunk gets a keyed 128-bit
identifier, and a document becomes its ordered list of identifiers, its recipe. Identifiers are verified: every
chunk content travels once to the reducer of its identifier, where contents must agree; should two contents ever
share an identifier, all recipes are made again with another key. Afterwards texts are equal exactly when their
recipes are, and only recipes (16 bytes a chunk) are grouped and joined; texts never move again.

Defined results: null text counts as empty; rows with the same id and the same text are all kept or all dropped
together; a null id is never the one that stays unless its whole group has null ids; extra columns are ignored. An
empty table gives an empty result; long texts are cut in slices that overlap by the hash's window, so chunks do not depend on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import join_by_group, written

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 2048, 65536, 12
SLICE_BYTES = 8 << 20
_GEAR = np.frombuffer(hashlib.shake_256(b"corvane gear").digest(1024), dtype=np.uint32)
_WINDOW = 32


def gear_hits(data: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash asks for a cut; each depends on 32 bytes only."""
    h = _GEAR[data]
    width = 1
    while width < _WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(width)
        h = h + older
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def chunk_ends(size: int, hits: np.ndarray) -> list[int]:
    """Ends of a text's chunks from the cut positions inside it (relative, rising)."""
    ends, start, k = [], 0, 0
    hits = hits.tolist()
    while size - start > MIN_CHUNK:
        while k < len(hits) and hits[k] - start < MIN_CHUNK:
            k += 1
        cut = hits[k] if k < len(hits) else size
        cut = min(cut, start + MAX_CHUNK, size)
        ends.append(cut)
        start = cut
    if start < size or not ends:
        ends.append(size)
    return ends


def chunks_of(text: bytes) -> list[bytes]:
    if len(text) <= MIN_CHUNK:
        return [text]
    hits = np.concatenate(
        [gear_hits(np.frombuffer(text[max(0, at - _WINDOW) : at + SLICE_BYTES], np.uint8)) + max(0, at - _WINDOW)
         for at in range(0, len(text), SLICE_BYTES)]
    )
    hits = np.unique(hits[hits >= MIN_CHUNK])
    start, out = 0, []
    for end in chunk_ends(len(text), hits):
        out.append(text[start:end])
        start = end
    return out


def _identifier(key: bytes) -> Callable[[bytes], bytes]:
    return lambda chunk: hashlib.blake2b(chunk, digest_size=16, key=key).digest()


def _recipes(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = _identifier(key)
        for batch in batches:
            recipe, sha = [], []
            for value in batch.column(1):
                text = (value.as_py() or "").encode()
                recipe.append(b"".join(map(ident, chunks_of(text))))
                sha.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(recipe, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "recipe", "text_sha256"],
            )

    return run


def _contents(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, seen = _identifier(key), {}
        for batch in batches:
            ids, contents = [], []
            for value in batch.column(0):
                for chunk in chunks_of((value.as_py() or "").encode()):
                    name = ident(chunk)
                    # A short second hash tells a repeated chunk from a clash that must travel.
                    mark = hash(chunk)
                    if seen.get(name) != mark:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen[name] = mark
                        ids.append(name)
                        contents.append(chunk)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], names=["chunk_id", "content"]
            )

    return run


def verified_key(docs: DataFrame, text: str = "text") -> bytes:
    """The first key under which no two different chunks of docs share an identifier."""
    for attempt in range(8):
        key = b"corvane-%d" % attempt
        chunks = docs.select(text).mapInArrow(_contents(key), "chunk_id binary, content binary")
        clash = chunks.groupBy("chunk_id").agg(F.min("content").alias("a"), F.max("content").alias("b"))
        if clash.filter("a <> b").isEmpty():
            return key
    raise RuntimeError("chunk identifiers clash under every key")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    key = verified_key(docs)
    recipes = written(
        docs.select("doc_id", "text").mapInArrow(
            _recipes(key), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, recipe binary, text_sha256 string"
        ),
        "recipes",
    )
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = join_by_group(recipes, written(groups, "recipe_groups"), "recipe", "group_size", recipes.count())
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.expr("cast(length(recipe) div 16 as int)").alias("n_chunks"),
    )
