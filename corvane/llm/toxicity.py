"""Toxic span tagging by a linear-chain conditional random field.

Token labels come from document labels: on a bounded sample (PER_CLASS documents of each label, chosen by a hash of
the id), toxic words are the words and stems (beginnings of words) that are far more frequent in toxic than in clean
documents of the same language (`lang`, where docs has it); their tokens in toxic documents of that language are
labelled toxic, all others clean. Texts are cut in segments of SEGMENT tokens; the field learns from all segments with a
toxic token and from twice as many others plus 500, drawn evenly. It has two states, features of the word, its stem
and both neighbours (hashed weights), and transition weights, trained by gradient steps on the exact likelihood. At scoring, forward-backward over each whole text gives every token's marginal; a document's
score is the noisy-or of its marginals above FLOOR (below it, marginals of thousands of clean tokens would add up to a
toxic document), and tokens at half or more are its offending spans.

Defined results: null and empty texts score 0, as does everything when no labelled row of both kinds exists. An id that
is labelled more than once is toxic when one of its labels is; a repeated id is one labelled document, and each of its
rows is scored for itself. Only doc_id, text and lang (for training) are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, fold
from corvane.llm.token_count import ascii_words, slices

PER_CLASS, PIECES, PIECE_CHARS, SEGMENT = 1500, 20, 1000, 64
WORD_BITS, STEM_BITS, EPOCHS, RATE, DECAY, FLOOR = 18, 14, 6, 0.3, 1e-6, 0.1
LEAST, LIFT, CHANCE = 3, 20, 1e-3
SLICE_BYTES = 6 << 20
_EDGE = re.compile(r"^\W+|\W+$")


def normal(word: str) -> str:
    return _EDGE.sub("", word.lower())


def _slot(text: str, bits: int) -> int:
    return zlib.crc32(text.encode()) & ((1 << bits) - 1)


def traits(form: str) -> set[str]:
    """What can mark a word as toxic: the word itself or its first four or five letters."""
    return {form, *(form[:n] + "*" for n in (4, 5) if len(form) > n)} if form else set()


def unlikely(n: int, of: int, share: float) -> float:
    """Chance of n or more toxic documents among `of` documents when each is toxic with this share."""
    logs = [
        math.lgamma(of + 1) - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * math.log(share) + (of - k) * math.log1p(-share)
        for k in range(n, of + 1)
    ]
    return math.fsum(map(math.exp, logs))


def toxic_words(toxic: list[set[str]], clean: list[set[str]]) -> set[str]:
    """Words of one vocabulary whose own document counts tie them to the toxic label.

    A word needs LEAST toxic documents, LIFT times the clean documents' rate, and a count that chance explains with at
    most CHANCE; none of these depends on other words or rises with the sample.
    """
    if not toxic or not clean:
        return set()
    against = Counter(w for d in clean for w in d)
    share = len(toxic) / (len(toxic) + len(clean))
    return {
        w for w, n in Counter(w for d in toxic for w in d).items()
        if n >= LEAST and n * len(clean) >= LIFT * against[w] * len(toxic) and unlikely(n, n + against[w], share) <= CHANCE
    }


class ToxicField:
    """Weights: word, stem, previous and next word (state toxic against clean), bias and transitions."""

    def __init__(self) -> None:
        self.word = np.zeros(1 << WORD_BITS)
        self.prev = np.zeros(1 << WORD_BITS)
        self.next = np.zeros(1 << WORD_BITS)
        self.stem = np.zeros(1 << STEM_BITS)
        self.bias = np.array([-3.0])
        self.trans = np.zeros((2, 2))

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of each word and of its stem."""
        forms = [normal(w) for w in words]
        n = len(words)
        return (
            np.fromiter((_slot(f, WORD_BITS) for f in forms), np.int64, n),
            np.fromiter((_slot(f[:4], STEM_BITS) for f in forms), np.int64, n),
        )

    def marginals(self, emission: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of the toxic state of each token, and forward and backward odds (toxic against clean).

        emission: log odds of all tokens, text after text. All texts step together, longest first.
        """
        odds = np.exp(np.clip(emission, -30, 30))
        a = np.exp(self.trans)
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        size = sizes[order]
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        forward, backward = np.empty(len(odds)), np.ones(len(odds))
        for t in range(longest):
            at = starts[: active[t]] + t
            if t == 0:
                forward[at] = odds[at]
            else:
                f = forward[at - 1]
                forward[at] = odds[at] * (a[0, 1] + a[1, 1] * f) / (a[0, 0] + a[1, 0] * f)
        for t in range(longest - 2, -1, -1):
            at = starts[: active[t + 1]] + t
            g = odds[at + 1] * backward[at + 1]
            backward[at] = (a[1, 0] + a[1, 1] * g) / (a[0, 0] + a[0, 1] * g)
        joint = forward * backward
        return joint / (1 + joint), forward, backward

    def emissions(self, word: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        e = self.word[word] + self.stem[end] + self.bias[0]
        if len(e):
            ends = np.cumsum(sizes[sizes > 0])
            inner = np.ones(len(e), bool)
            inner[ends - 1] = False
            e[:-1] += np.where(inner[:-1], self.next[word[1:]], 0)
            e[1:] += np.where(inner[:-1], self.prev[word[:-1]], 0)
        return e

    def train(self, segments: list[tuple[list[str], list[bool]]], epochs: int = EPOCHS, seed: int = 3) -> None:
        """AdaGrad on the exact log-likelihood, batches of segments."""
        rng = np.random.default_rng(seed)
        made = [(*self.features(w), np.array(y, float)) for w, y in segments]
        tables = {"word": self.word, "stem": self.stem, "prev": self.prev, "next": self.next, "bias": self.bias}
        squares = {k: np.full(v.shape, 1e-6) for k, v in tables.items()}
        trans_square = np.full((2, 2), 1e-6)
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(made)), max(1, len(made) // 256)):
                word, end, y = (np.concatenate([made[i][k] for i in batch]) for k in range(3))
                sizes = np.array([len(made[i][2]) for i in batch])
                e = self.emissions(word, end, sizes)
                p, forward, backward = self.marginals(e, sizes)
                g = (p - y) / len(batch)
                inner = np.ones(len(g), bool)
                inner[np.cumsum(sizes) - 1] = False
                left = np.flatnonzero(inner[:-1]) if len(g) > 1 else np.zeros(0, np.int64)
                steps = {"word": (word, g), "stem": (end, g), "prev": (word[left], g[left + 1]),
                         "next": (word[left + 1], g[left]), "bias": (np.zeros(len(g), np.int64), g)}
                for k, (slot, grad) in steps.items():
                    used, where = np.unique(slot, return_inverse=True)
                    total = np.bincount(where, grad, len(used)) + DECAY * tables[k][used]
                    squares[k][used] += total**2
                    tables[k][used] -= RATE * total / np.sqrt(squares[k][used])
                # Expected less observed transitions.
                a = np.exp(self.trans)
                odds = np.exp(np.clip(e, -30, 30))[left + 1] * backward[left + 1]
                pair = np.stack([np.full(len(left), a[0, 0]), a[0, 1] * odds, a[1, 0] * forward[left],
                                 a[1, 1] * forward[left] * odds])
                pair /= pair.sum(axis=0)
                i, j = y[left].astype(int), y[left + 1].astype(int)
                seen = np.bincount(2 * i + j, minlength=4)
                grad = ((pair.sum(axis=1) - seen) / len(batch)).reshape(2, 2) + DECAY * self.trans
                trans_square += grad**2
                self.trans -= RATE * grad / np.sqrt(trans_square)


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = PER_CLASS) -> list:
    """(text, toxic, lang) of at most per_class documents of each label outside fold 0; of a longer text, PIECES pieces
    of PIECE_CHARS characters, evenly spread, so that what reaches the driver has a bound."""
    marked = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = None
    for toxic in (0, 1):
        part = marked.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class ids, whatever the input.
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    found = docs.select("doc_id", "text", lang.cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id")
    long = F.length("text") > PIECES * PIECE_CHARS
    step = F.length("text") / PIECES
    pieces = [F.substring(F.col("text"), (step * k).cast("int") + 1, F.lit(PIECE_CHARS)) for k in range(PIECES)]
    found = found.withColumn("text", F.when(long, F.concat_ws(" ", *pieces)).otherwise(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy("text", "lang")
    # Repeated ids are one labelled document.
    first = found.filter(F.length("text") > 0).withColumn("_nth", F.row_number().over(order)).filter("_nth = 1")
    return [(r["text"], r["toxic"], r["lang"]) for r in sorted(first.collect(), key=lambda r: r["doc_id"])]


def fit(rows: list[tuple[str, int, str | None]], seed: int = 5) -> ToxicField | None:
    texts = [(re.findall(WORD, t), y, lang) for t, y, lang in rows]
    groups: dict[str | None, tuple[list, list]] = {}
    for words, y, lang in texts:
        found = set().union(*(traits(f) for f in {normal(w) for w in words}))
        groups.setdefault(lang, ([], []))[0 if y else 1].append(found)
    bad = {lang: toxic_words(toxic, clean) for lang, (toxic, clean) in groups.items()}
    if not any(bad.values()):
        return None
    rng = np.random.default_rng(seed)
    with_hits, without = [], []
    for words, y, lang in texts:
        tags = [bool(y) and not bad[lang].isdisjoint(traits(normal(w))) for w in words]
        for at in range(0, len(words), SEGMENT):
            part = (words[at : at + SEGMENT], tags[at : at + SEGMENT])
            (with_hits if any(part[1]) else without).append(part)
    rest = [without[i] for i in rng.permutation(len(without))[: 2 * len(with_hits) + 500]]
    field = ToxicField()
    field.train(with_hits + rest)
    return field


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (code-point offsets, end exclusive) for every row of docs."""
    field = fit(training_rows(docs, labels, folds))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # hashed tables of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, column=2, most=SLICE_BYTES):
                texts = part.column(2)
                n = len(texts)
                score, spans = np.zeros(n), [[] for _ in range(n)]
                words, sizes = ascii_words(texts)
                if model is not None and len(words):
                    coded = words.dictionary_encode()
                    codes = coded.indices.to_numpy()
                    word, end = model.features(coded.dictionary.to_pylist())
                    p, _, _ = model.marginals(model.emissions(word[codes], end[codes], sizes), sizes)
                    owner = np.repeat(np.arange(n), sizes)
                    strong = np.flatnonzero(p >= FLOOR)
                    none = np.bincount(owner[strong], np.log1p(-np.minimum(p[strong], 1 - 1e-12)), n)
                    score = np.clip(-np.expm1(none), 0, 1)
                    starts = np.cumsum(sizes) - sizes
                    for k in np.flatnonzero(p >= 0.5):
                        spans[owner[k]].append(k - starts[owner[k]])
                    for k, hits in enumerate(spans):
                        if hits:
                            found = list(re.finditer(WORD, texts[k].as_py()))
                            spans[k] = [{"start": found[h].start(), "end": found[h].end()} for h in hits]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                     pa.array(spans, kind)],
                    names=["doc_id", "held_out", "score", "predicted", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"
    )
