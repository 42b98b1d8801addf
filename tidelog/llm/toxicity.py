"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text, and the lengths to which windows compress.

Windows are words (longer runs: pieces of WIDEST characters), each byte written as `widen` keyed bytes, so that a dictionary match of a few letters
is shorter than its letters. The toxic dictionary holds the words over-represented in toxic documents of the
sample, the ordinary one the most frequent words of the others. Calibration turns the pair of compressed lengths into a
log-likelihood ratio, thresholds it, and a logistic step turns a document's sum into a probability.
"""

from __future__ import annotations

import functools
import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples
from .common import byte_chunks, give_back, texts_of

STRIP = ".,!?;:\"'()[]{}…«»„“”"
WIDEST = 64
#: Size in bytes of the dictionaries.
TOXIC_BYTES, ORDINARY_BYTES = 65_536, 131_072
#: Cells of compressed lengths along each side.
CELLS = 96
#: A window counts where its log-likelihood ratio exceeds this.
FLOOR = 0.7
REMEMBERED = 500_000


def _keys(widen: int) -> list[bytes]:
    tables = []
    for k in range(widen):
        table = list(range(256))
        random.Random(1000 + k).shuffle(table)
        tables.append(bytes(table))
    return tables


def widened(word: str, keys: list[bytes]) -> bytes:
    raw = f" {word} ".encode()
    out = bytearray(len(keys) * len(raw))
    for k, table in enumerate(keys):
        out[k :: len(keys)] = raw.translate(table)
    return bytes(out)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    widen: int
    level: int
    ratios: bytes  # CELLS x CELLS float32
    weights: tuple[float, ...]

    def words(self) -> Words:
        return _words(self)

    def forget(self) -> None:
        """Frees the words seen; a worker may live on to do other work."""
        if self.toxic:
            self.words().clear()
        give_back()

    def features(self, text: str) -> tuple[float, float, float]:
        tokens = text.lower().split()
        found = np.fromiter(map(self.words().__getitem__, tokens), np.float32, len(tokens))
        total = float(found.sum())
        return 1.0, math.log1p(total), total / math.sqrt(len(tokens) + 20.0)

    def score(self, text: str) -> float:
        if not self.toxic:
            return self.weights[0]
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def windows(body: str) -> list[str]:
    """A word is one window; a longer run is cut into windows that overlap by half, so that a shorter word on a cut is whole in one of them."""
    return [body] if len(body) <= WIDEST else [body[i : i + WIDEST] for i in range(0, len(body) - WIDEST // 2, WIDEST // 2)]


class Lengths:
    """The cell of a window: its two compressed lengths."""

    def __init__(self, toxic: bytes, ordinary: bytes, widen: int, level: int):
        import zstandard as z

        self.keys, self.unit = _keys(widen), 9 * widen + 20
        make = lambda d: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.both = make(ordinary), make(toxic)

    def cell(self, word: str) -> int:
        raw = widened(word, self.keys)
        a, b = (min(len(f(raw)) * CELLS // self.unit, CELLS - 1) for f in self.both)
        return a * CELLS + b


class Words(dict):
    """word -> what it adds to a document's sum; forgets all when full."""

    def __init__(self, model: Model):
        self.cell = Lengths(model.toxic, model.ordinary, model.widen, model.level).cell
        self.ratios = np.maximum(np.frombuffer(model.ratios, np.float32) - FLOOR, 0).tolist()

    def __missing__(self, word: str) -> float:
        body = word.strip(STRIP)
        if len(word) > WIDEST:
            return sum(self.ratios[self.cell(w)] for w in windows(body))
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.ratios[self.cell(body)]
        return value


@functools.lru_cache(2)
def _words(model: Model) -> Words:
    return Words(model)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
    return w


def fit(texts: list[str], labels: list[int], toxic_share: float, widen: int = 12, level: int = 9, tilt: float = 2.0) -> Model:
    """Half of the sample fills the dictionaries, a quarter calibrates the ratios, a quarter the probabilities. tilt: weight of a toxic document against a clean one."""
    sides = {c: [t for t, y in zip(texts, labels, strict=True) if y == c] for c in (0, 1)}
    part = lambda c, *ks: [t for i, t in enumerate(sides[c]) if i % 4 in ks]
    words = lambda t: [w.strip(STRIP) for w in t.lower().split()]
    bad, good, often = Counter(), Counter(), Counter()
    for t in part(1, 0, 1):
        bad.update(w for w in set(words(t)) if w and len(w) <= WIDEST)
    for t in part(0, 0, 1):
        every = [w for w in words(t) if w and len(w) <= WIDEST]
        good.update(set(every))
        often.update(every)
    n_bad, n_good = len(part(1, 0, 1)) + 1, len(part(0, 0, 1)) + 1
    gain = lambda w: math.log((bad[w] + 0.5) / n_bad * n_good / (good[w] + 0.5))
    chosen = sorted((bad[w] * gain(w), w) for w in bad if bad[w] >= 4 and gain(w) >= math.log(8) and bad[w] * gain(w) >= 15)
    keys = _keys(widen)
    toxic = b"".join(widened(w, keys) for _, w in chosen)[-TOXIC_BYTES:]
    ordinary = b"".join(widened(w, keys) for w, _ in reversed(sorted(often.items(), key=lambda x: (-x[1], x[0]))[:2500]))[-ORDINARY_BYTES:]
    if len(toxic) < 8 or len(ordinary) < 8:
        return Model(b"", b"", widen, level, b"", (min(0.49, toxic_share),))
    lengths, cells = Lengths(toxic, ordinary, widen, level), {}

    def counted(ts: list[str]) -> np.ndarray:
        out = np.zeros(CELLS * CELLS)
        for w, n in Counter(x for t in ts for w in words(t) for x in windows(w)).items():
            if w not in cells:
                cells[w] = lengths.cell(w)
            out[cells[w]] += n
        return out

    a, b = counted(part(1, 2)), counted(part(0, 2))
    na, nb = max(a.sum(), 1), max(b.sum(), 1)
    ratios = np.log((a + 1) / na) - np.log((b + nb / na) / nb)
    ratios[a + b < 3] = 0
    model = Model(toxic, ordinary, widen, level, ratios.astype(np.float32).tobytes(), (0.0, 0.0, 0.0))
    rest = [(t, c) for c in (0, 1) for t in part(c, 3)] or [("", 0)]
    x, y = np.array([model.features(t) for t, _ in rest]), np.array([c for _, c in rest], float)
    share = np.array([max((y == c).mean(), 1e-9) for c in (0, 1)])
    weight = np.where(y == 1, tilt * toxic_share / share[1], (1 - toxic_share) / share[0])
    return Model(toxic, ordinary, widen, level, model.ratios, tuple(_logistic(x, y, weight).tolist()))


def fitted(docs: DataFrame, labels: DataFrame, rows: int = samples.ROWS) -> Model:
    texts, marks, totals = samples.labelled(docs, labels, "toxic", rows)
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    return fit(texts, marks, share)


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, cut: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; score is the probability of the toxic label given the whole text, nothing else.

    Null or empty text: the score of no evidence. Very long texts: all their windows. Without toxic labels to learn from, a constant below
    one half. Repeated rows and null keys: a row each (null: held_out false). Empty table: empty result.
    """
    model = model or fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([model.score(t) for t in texts_of(batch)], pa.float64())], names=["doc_id", "score"])
        model.forget()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs without the rows that score `cut` or more; every column as it was."""
    model = model or fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_chunks(batches, text):
            yield batch.filter(pa.array([model.score(t) < cut for t in texts_of(batch, text)], pa.bool_()))
        model.forget()

    return docs.mapInArrow(run, docs.schema)
