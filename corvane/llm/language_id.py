"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of labelled documents: a bounded sample
(PER_LANG documents, chosen by a hash of the id, for each of the LANGS most frequent languages, WINDOWS windows of
WIDTH characters at hashed places of each). At
prediction every byte of the whole text gets a distribution over languages from both directions; texts run as
windows of WIDTH bytes side by side, and a document's probabilities are the mean over its positions.

Defined results: null texts and texts without a letter are `und` with score 0; without any labelled row everything is
`und` with score 0; lang, source and doc_id are no inputs of a prediction. Every row is judged for itself, so
repeated rows get equal results; of equal probabilities the first language by name wins; texts of any length
are read whole, in slices of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import fold
from corvane.llm.token_count import slices

HIDDEN, WIDTH, PER_LANG, WINDOWS, LANGS = 8, 64, 600, 4, 500
STEPS, BATCH, RATE, LANES = 250, 256, 0.02, 2048
UNKNOWN = "und"


def training_windows(docs: DataFrame, folds: int = 5, per_lang: int = PER_LANG, langs: int = LANGS) -> list[tuple[str, str]]:
    """(lang, window) of the bounded sample: per_lang documents, those of the least hashes, for each of the `langs`
    most frequent languages, WINDOWS pieces of each.

    One pass counts the languages. As hashes are even, a bar on the hash then leaves about four times the wanted
    documents of each language, and only these are ranked.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id"), folds) != 0))
    rows = rows.withColumn("h", F.xxhash64("doc_id"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    if not counts:
        return []
    span = float(2**63)
    bars = [(r["lang"], int(min(span - 1025, span * (8.0 * (per_lang + 16) / r["n"] - 1)))) for r in counts]
    bar = docs.sparkSession.createDataFrame(bars, "lang string, bar long")
    room = F.greatest(F.length("text") - WIDTH, F.lit(0)) + 1
    places = [F.pmod(F.xxhash64(F.lit(k), "doc_id"), room).cast("int") + 1 for k in range(WINDOWS)]
    cut = F.array(*[F.substring(F.col("text"), p, F.lit(WIDTH)) for p in places])
    near = rows.join(F.broadcast(bar), "lang").filter("h <= bar").select("lang", "h", cut.alias("w"))
    order = Window.partitionBy("lang").orderBy("h", "w")
    found = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_lang)
    found = found.select("lang", "h", F.posexplode("w").alias("k", "w")).collect()
    return [(r["lang"], r["w"]) for r in sorted(found, key=lambda r: (r["lang"], r["h"], r["k"], r["w"])) if r["w"]]


def as_windows(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows (rows, width), the number of real bytes in each, and each window's text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    rows = -(-sizes // width)
    total = int(rows.sum())
    flat = np.zeros(total * width, np.uint8)
    starts = (np.cumsum(rows) - rows) * width
    data = np.frombuffer(b"".join(texts), np.uint8)
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))
    flat[place] = data
    owner = np.repeat(np.arange(len(texts)), rows)
    nth = np.arange(total) - np.repeat(np.cumsum(rows) - rows, rows)
    return flat.reshape(-1, width), np.minimum(sizes[owner] - nth * width, width), owner


class ByteGru:
    """Two gated recurrent layers, one for each direction, and a softmax at every position."""

    def __init__(self, n_out: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"Wo": draw(2 * hidden, n_out), "bo": np.zeros(n_out, np.float32)}
        for d in "fb":
            self.p["X" + d] = draw(256, 3 * hidden)
            self.p["U" + d] = draw(hidden, 3 * hidden)

    def _states(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (T, B, H) in the order of reading; keep gathers what backpropagation needs."""
        h3, h = self.h, np.zeros((x.shape[1], self.h), np.float32)
        X, U = self.p["X" + d], self.p["U" + d]
        out = np.empty((*x.shape, h3), np.float32)
        for t in range(len(x)):
            xs = X[x[t]]
            hu = h @ U
            gate = np.tanh(0.5 * (xs[:, : 2 * h3] + hu[:, : 2 * h3]))
            gate += 1.0
            gate *= 0.5
            z, r = gate[:, :h3], gate[:, h3:]
            n = np.tanh(xs[:, 2 * h3 :] + r * hu[:, 2 * h3 :])
            before = h
            h = n + z * (h - n)
            out[t] = h
            if keep is not None:
                keep.append((before, z, r, n, hu[:, 2 * h3 :]))
        return out

    def logits(self, x: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """x (T, B) bytes; logits (T, B, n) and joined states."""
        kf, kb = ([], []) if keep is not None else (None, None)
        forward = self._states(x, "f", kf)
        backward = self._states(x[::-1], "b", kb)[::-1]
        states = np.concatenate([forward, backward], axis=2)
        if keep is not None:
            keep |= {"f": kf, "b": kb}
        return states @ self.p["Wo"] + self.p["bo"], states

    def _back(self, x: np.ndarray, d: str, kept: list, dh_all: np.ndarray, grads: dict) -> None:
        h3, U = self.h, self.p["U" + d]
        dX, dU = np.zeros_like(self.p["X" + d]), np.zeros_like(U)
        carry = np.zeros((x.shape[1], h3), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, n, un = kept[t]
            dh = dh_all[t] + carry
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            to_x = np.concatenate([dz, dr, dn], axis=1)
            to_u = np.concatenate([dz, dr, dn * r], axis=1)
            carry = dh * z + to_u @ U.T
            dU += before.T @ to_u
            np.add.at(dX, x[t], to_x)
        grads["X" + d], grads["U" + d] = dX, dU

    def train(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, steps: int, rate: float, seed: int = 1) -> None:
        """Adam on the mean cross-entropy of all real positions."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(BATCH, len(x)))
            xs, ys = np.ascontiguousarray(x[pick].T), y[pick]
            real = (np.arange(len(xs))[:, None] < size[pick]).astype(np.float32)
            keep: dict = {}
            logits, states = self.logits(xs, keep)
            e = np.exp(logits - logits.max(axis=2, keepdims=True))
            d = e / e.sum(axis=2, keepdims=True)
            d[:, np.arange(len(ys)), ys] -= 1
            d *= (real / real.sum())[:, :, None]
            flat_d, flat_s = d.reshape(-1, d.shape[2]), states.reshape(-1, states.shape[2])
            grads = {"Wo": flat_s.T @ flat_d, "bo": flat_d.sum(axis=0)}
            dh = d @ self.p["Wo"].T
            self._back(xs, "f", keep["f"], dh[:, :, : self.h], grads)
            self._back(xs[::-1], "b", keep["b"], dh[::-1, :, self.h :], grads)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution over all positions of each text."""
        x, size, owner = as_windows(texts)
        n = len(self.p["bo"])
        sums = np.zeros((len(texts), n))
        for at in range(0, len(x), LANES):
            part = np.ascontiguousarray(x[at : at + LANES].T)
            logits, _ = self.logits(part)
            e = np.exp(logits)
            e /= e.sum(axis=2, keepdims=True)
            e *= (np.arange(len(part))[:, None] < size[at : at + LANES])[:, :, None]
            each = e.sum(axis=0)
            for k in range(n):
                sums[:, k] += np.bincount(owner[at : at + LANES], each[:, k], len(texts))
        return sums / np.maximum(np.fromiter(map(len, texts), float, len(texts)), 1)[:, None]


def fit(samples: list[tuple[str, str]]) -> tuple[ByteGru | None, list[str]]:
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None, []
    net = ByteGru(len(langs))
    x, size, owner = as_windows([w.encode() for _, w in samples])
    y = np.array([langs.index(lang) for lang, _ in samples])[owner]
    net.train(x, size, y, STEPS, RATE)
    return net, langs


def judge_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """docs, all columns, with held_out, lang_pred and score for every row; learns from the rows outside fold 0."""
    net, langs = fit(training_windows(docs, folds))
    shared = docs.sparkSession.sparkContext.broadcast((net, langs))  # some ten thousand numbers
    marked = docs.withColumn("held_out", fold(F.col("doc_id"), folds) == 0)
    made = marked.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value
        for batch in batches:
            for part in slices(batch, column=at):
                column = part.column(at)
                texts = [(t or "").encode() for t in column.to_pylist()]
                named = pc.match_substring_regex(column, r"\pL").fill_null(False).to_numpy(zero_copy_only=False)
                if model is None:
                    best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                else:
                    pooled = model.pooled(texts)
                    top = pooled.argmax(axis=1)
                    best = [names[k] if ok else UNKNOWN for k, ok in zip(top, named, strict=True)]
                    score = np.clip(pooled.max(axis=1), 0, 1) * named
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(best, pa.string()), pa.array(score, pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"],
                )

    return marked.mapInArrow(run, made)


def detect_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learns from the rows outside fold 0."""
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return judge_languages(docs.select("doc_id", "text", lang.alias("lang")), folds).drop("text", "lang")
