"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network with calibrated temperature.

Every word is two tokens: its letters (hashed into WORDS buckets) and its form - case pattern, digits and punctuation - (FORMS buckets). A token's index
vector is a sparse random one; its context vector is the sum of the index vectors of the words beside it over the whole
corpus, so the table has a fixed size however much text it has seen. A document is the mean of its tokens' context
vectors, with the lengths of its mean index vectors, which tell how often it repeats itself.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples
from .common import byte_chunks, durable, texts_of

WORDS, FORMS, DIM, NONZERO = 1 << 14, 1 << 10, 32, 2
TOKENS = WORDS + FORMS
#: Ranges of the table that partitions are summed by.
RANGES = 16
REMEMBERED = 400_000
#: Words of a text that are looked at together; longer texts are taken in slices.
TOGETHER = 50_000
HIDDEN = 24

_RUN = re.compile(r"(.)\1+")


def form_of(word: str) -> str:
    """Letters become x or X, digits 0; other characters stay; runs shrink to two."""
    shape = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1\1", shape)


class Tokens(dict):
    """word -> word bucket * FORMS + form bucket; forgets all when full."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest as xx

        body = "".join(filter(str.isalnum, word)).lower()
        value = (xx(body.encode(), 1) % WORDS) * FORMS + xx(form_of(word).encode(), 2) % FORMS
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


_TOKENS = Tokens()


def token_ids(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    both = np.fromiter(map(_TOKENS.__getitem__, words), np.int64, len(words))
    return both // FORMS, WORDS + both % FORMS


@functools.lru_cache(1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of each token's index vector; a fixed function of the token."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, DIM, (TOKENS, NONZERO)), rng.choice([-1.0, 1.0], (TOKENS, NONZERO))


@functools.lru_cache(1)
def dense_index() -> np.ndarray:
    places, signs = index_vectors()
    out = np.zeros((TOKENS, DIM), np.float32)
    np.add.at(out, (np.arange(TOKENS)[:, None], places), signs)
    return out


def add_contexts(total: np.ndarray, texts: list[str]) -> None:
    """Adds, for each token, the index vectors of the tokens of the words before and after it."""
    places, signs = index_vectors()
    pairs_w, pairs_c, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if pairs_w:
            w, c = np.concatenate(pairs_w), np.concatenate(pairs_c)
            for k in range(NONZERO):
                np.add(total, np.bincount(w * DIM + places[c, k], weights=signs[c, k], minlength=TOKENS * DIM), out=total)
        pairs_w.clear()
        pairs_c.clear()
        held = 0

    for text in texts:
        every = token_ids(text)
        for at in range(0, len(every[0]) - 1, TOGETHER):
            w, f = (x[at : at + TOGETHER + 1] for x in every)
            for centre, beside in ((w, w), (w, f), (f, w), (f, f)):
                pairs_w += [centre[:-1], centre[1:]]
                pairs_c += [beside[1:], beside[:-1]]
            held += len(w)
            if held >= 4 * TOGETHER:
                flush()
    flush()


def context_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The TOKENS x DIM context vectors over every row of docs; partitions send partial sums by range of tokens, never rows."""
    step = -(-TOKENS // RANGES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOKENS * DIM)
        for batch in byte_chunks(batches, most=1 << 20):
            add_contexts(total, texts_of(batch))
        parts = [(r, total[r * step * DIM : (r + 1) * step * DIM].astype("<i4").tobytes()) for r in range(RANGES)] if total.any() else []
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["part", "data"])

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, data in zip(frame["part"], frame["data"], strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(data, "<i4").astype("<i8")
        yield pd.DataFrame({"part": list(held), "data": [v.astype("<i8").tobytes() for v in held.values()]})

    partial = docs.select(F.col(text).alias("text")).mapInArrow(sums, "part int, data binary")
    merged = partial.repartition(RANGES, "part").mapInPandas(merge, "part int, data binary")
    out = np.zeros(TOKENS * DIM)
    for part, data in sorted((r["part"], r["data"]) for r in durable(merged, "contexts").collect()):  # RANGES rows or so, of a fixed size
        values = np.frombuffer(data, "<i8")
        out[part * step * DIM : part * step * DIM + len(values)] += values
    return unit(out.reshape(TOKENS, DIM))


def unit(table: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(text: str, contexts: np.ndarray) -> np.ndarray:
    w, f = token_ids(text)
    if not len(w):
        return np.zeros(2 * DIM + 5)
    index = dense_index()
    mean = lambda table, ids: table[ids].mean(0) if len(ids) <= TOGETHER else np.bincount(ids, minlength=TOKENS) @ table / len(ids)
    w_mean, f_mean = mean(contexts, w), mean(contexts, f)
    same = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
    extra = [np.linalg.norm(mean(index, w)), np.linalg.norm(mean(index, f)), same, np.log1p(len(w)) / 8, len(set(w.tolist())) / len(w)]
    return np.concatenate([w_mean, f_mean, extra])


@dataclass
class Network:
    contexts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2).ravel()

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([pooled(t, self.contexts) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30))) if len(texts) else np.zeros(0)


def train(contexts: np.ndarray, texts: list[str], labels: list[int], rounds: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam over the whole sample; every fourth document only calibrates the temperature."""
    rng = np.random.default_rng(seed)
    x, y = np.array([pooled(t, contexts) for t in texts] or [np.zeros(2 * DIM + 5)]), np.array(labels or [1], float)
    fit, held = np.arange(len(y)) % 4 != 3, np.arange(len(y)) % 4 == 3
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    net = Network(contexts, mean, scale, layers, 1.0)
    a, t = (x[fit] - mean) / scale, y[fit]
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, rounds + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(a @ w1 + b1)
        p = 1 / (1 + np.exp(-np.clip((h @ w2 + b2).ravel(), -30, 30)))
        g = ((p - t) / len(t))[:, None]
        back = g @ w2.T * (1 - h * h)
        for i, d in enumerate((a.T @ back + decay * w1, back.sum(0), h.T @ g + decay * w2, g.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            layers[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    if held.any():
        raw, t = net.raw(x[held]), y[held]
        loss = lambda k: float(np.mean(np.logaddexp(0, raw / k) - t * raw / k))
        net.temperature = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 6.0), key=loss)
    return net


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, rows: int = samples.ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; score is the probability of the quality label given the whole text, nothing else.

    The context vectors come from all rows of docs, the network from a sample of `rows` labelled ones outside the held-out fold. Null or empty text: the
    score of no tokens. Repeated rows and null keys: a row each (null: held_out false). Empty table: empty result.
    """
    contexts = context_table(docs, text)
    texts, marks, _ = samples.labelled(docs, labels, "quality", rows, by_class=False, key=key, text=text)
    net = train(contexts, texts, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(net.scores(texts_of(batch)), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
