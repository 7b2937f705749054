"""Quality by random-indexing word vectors and a small network.

Every word has a sparse random index vector that only its hash decides. A word's vector is the sum of the index vectors
of the words around it, over the texts learned from, so words of like company get like vectors; a second table does the
same for word shapes (which letters, capitals, digits and signs a word begins and ends with). A document is the mean and
the spread of its words' vectors. A network of two layers in numpy reads that, and a temperature fitted on texts that
the network did not see makes its output a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold
from .toxicity import parts, sample

#: Rows of the word table (a word's row is its hash) and of the shape table, and the width of a vector.
WORD_ROWS, SHAPE_ROWS, WIDTH = 1 << 15, 1 << 10, 32
#: Entries of an index vector that are not zero; words on each side that are company.
NONZERO, REACH = 4, 2
#: Bound of the sample that is learned from: rows of each class, and bytes of one of its texts.
FIT_ROWS, FIT_BYTES = 3000, 20_000
HIDDEN, ROUNDS, SEED = 32, 60, 11
#: Words whose vectors are looked up at once.
WORDS = 1 << 16
_SHAPE = bytes(
    ord("a") if chr(b).islower() and b < 128 or b >= 128 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words and of their shapes. Words lie between ASCII white space."""
    said = text.split()
    crc = zlib.crc32
    words = np.fromiter(map(crc, text.lower().split()), np.int64, len(said)) % WORD_ROWS
    shapes = np.fromiter([crc(s[:2] + b"." + s[-3:]) for s in text.translate(_SHAPE).split()], np.int64, len(said)) % SHAPE_ROWS
    return words, shapes


def index_vectors(rows: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, WIDTH), np.float32)
    at = rng.random((rows, WIDTH)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (rows, NONZERO)), axis=1)
    return out


def word_vectors(texts: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """Context sums over all texts, with a word's own index vector, each of length one."""
    total = index.astype(np.float64)
    n = len(index)
    here, near = [], []
    for t in texts:
        for reach in range(1, REACH + 1):
            here += [t[:-reach], t[reach:]]
            near += [t[reach:], t[:-reach]]
    # How often each pair of rows met; the pairs are counted once, whatever the width.
    pairs, times = np.unique(np.concatenate(here) * n + np.concatenate(near) if here else np.zeros(0, np.int64), return_counts=True)
    for i in range(0, len(pairs), 1 << 20):
        a, b, k = pairs[i : i + (1 << 20)] // n, pairs[i : i + (1 << 20)] % n, times[i : i + (1 << 20)]
        for d in range(WIDTH):
            total[:, d] += np.bincount(a, k * index[b, d], n)
    total -= total.mean(axis=0)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    temperature: float
    share: float
    blank: bool = False  # nothing could be learned

    def score(self, text: str | None) -> float:
        if self.blank:
            return self.share
        logit = _logit(self.layers, (pool(self.words, self.shapes, (text or "").encode()) - self.mean)[None] / self.scale)[0]
        return float(1 / (1 + np.exp(-np.clip(logit / self.temperature, -40, 40))))


def pool(words: np.ndarray, shapes: np.ndarray, text: bytes) -> np.ndarray:
    """Mean and spread of the vectors of a text's words and shapes, and how like one word is to the next; zero without words."""
    sums, squares, alike, n = np.zeros(2 * WIDTH), np.zeros(2 * WIDTH), 0.0, 0
    for part in parts(text):
        w, s = tokens(part)
        for i in range(0, len(w), WORDS):
            v = np.concatenate([words[w[i : i + WORDS]], shapes[s[i : i + WORDS]]], axis=1)
            sums += v.sum(axis=0)
            squares += np.einsum("ij,ij->j", v, v)
            alike += float(np.einsum("ij,ij->", v[1:, :WIDTH], v[:-1, :WIDTH]))
            n += len(v)
    mean = sums / max(n, 1)
    return np.concatenate([mean, np.sqrt(np.maximum(squares / max(n, 1) - mean**2, 0)), [alike / max(n, 1), np.log1p(n)]])


def _logit(layers, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def fit(texts: list[str], classes: list[int], share: float | None = None, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Vectors, network and temperature from a bounded sample; ``share``: of class 1 where the texts come from."""
    y = np.asarray(classes, np.float64)
    words, shapes = index_vectors(WORD_ROWS, seed), index_vectors(SHAPE_ROWS, seed + 1)
    if len(set(classes)) < 2:
        width = 4 * WIDTH + 2
        none = (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(()))
        return Model(words, shapes, np.zeros(width), np.ones(width), none, 1.0, float((y.sum() + 0.5) / (len(y) + 1)), blank=True)
    known = [tokens(t.encode()) for t in texts]
    words = word_vectors([w for w, _ in known], words)
    shapes = word_vectors([s for _, s in known], shapes)
    x = np.stack([pool(words, shapes, t.encode()) for t in texts])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    share = float(y.mean()) if share is None else share
    # The classes weigh as they do where the texts come from.
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(v) for v in layers], [np.zeros_like(v) for v in layers], 0
    train = np.flatnonzero(~held)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            xs, hidden = x[part], np.maximum(x[part] @ layers[0] + layers[1], 0)
            slope = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -40, 40))) - y[part]) * weight[part] / len(part)
            back = np.outer(slope, layers[2]) * (hidden > 0)
            step += 1
            for k, g in enumerate((xs.T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * layers[2], slope.sum())):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                layers[k] = layers[k] - 0.002 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    some = held if held.any() else ~held
    return Model(words, shapes, mean, scale, tuple(layers), temperature(_logit(layers, x[some]), y[some], weight[some]), share)


def temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of the least weighted log loss, by golden section over its logarithm."""

    def loss(t: float) -> float:
        z = logit / np.exp(t)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    a, b, ratio = -2.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned; a null id has none."""
    return fold(doc_id, 3) != 1


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    known = sample(docs, labels, "quality", learnable(F.col("doc_id")), rows, most_bytes)
    share = labels.where(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    return fit([t for t, _ in known], [y for _, y in known], share)


def mark(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the network's score for that. Repeated rows stay repeated. A null id is
    not held out. Without labels of both classes every score is the smoothed share of label 1. An empty table gives no
    rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([known.score(t.as_py()) for t in batch["text"]], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return rows.select(
        "doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
