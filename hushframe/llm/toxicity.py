"""Toxicity by a bag of subwords.

Character n-grams of each word (its borders included) share a table of hashed embeddings; a window of words is the mean
of its embeddings, and a linear softmax tells its class. Table and softmax are trained together in numpy. A document is
as toxic as its worst window, so a few words count the same in short and in long texts, and a misspelled word still
shares most of its n-grams. After training an n-gram is one number, and scoring is a pass of numpy over the bytes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

GRAMS = (3, 4, 5)
BUCKETS, WIDTH = 1 << 16, 8
#: Words of a window.
WORDS = 8
#: Bound of the sample that is learned from: rows of each class, and bytes of one of its texts.
FIT_ROWS, FIT_BYTES = 3000, 20_000
ROUNDS, WHOLE, DECAY, SEED = 30, 2, 1e-6, 7
#: Bytes scored at once, and windows averaged at once.
CHUNK, WINDOWS = 1 << 20, 4096
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_MIX = np.uint32(0x9E3779B1)


@dataclass
class Grams:
    """The n-grams of a text: their buckets, in order of their words, and where each window's begin."""

    bucket: np.ndarray
    start: np.ndarray


def grams(text: bytes) -> Grams:
    """Only ASCII letters and digits and what lies beyond ASCII make words; a word counts with a border on each side."""
    folded = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    space = folded == 32
    first = np.flatnonzero(space[:-1] & ~space[1:])  # the border before each word
    if not len(first):
        return Grams(np.zeros(0, np.uint16), np.zeros(0, np.int64))
    spaces = np.cumsum(space, dtype=np.int32)
    word = np.cumsum(space[:-1] & ~space[1:], dtype=np.int32) - 1  # of the word that begins at or before a place
    code = folded.astype(np.uint32)
    buckets, owners = [], []
    rolled = code
    for n in range(2, max(GRAMS) + 1):
        if len(folded) < n:
            break
        rolled = rolled[: len(folded) - n + 1] * np.uint32(257) + code[n - 1 :]
        if n not in GRAMS:
            continue
        # No space strictly inside.
        inside = np.flatnonzero(spaces[n - 2 : len(folded) - 1] == spaces[: len(folded) - n + 1])
        buckets.append(((rolled[inside] * _MIX + np.uint32(n)) * _MIX >> np.uint32(16)).astype(np.uint16))
        owners.append(word[inside])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    window = owner // WORDS
    order = np.argsort(window, kind="stable")
    return Grams(bucket[order], np.searchsorted(window[order], np.arange(int(word[-1]) // WORDS + 1)))


@dataclass
class Model:
    """``weight``: what an n-gram adds to the logit of a window's mean; ``slope`` and ``bias`` calibrate the worst window."""

    weight: np.ndarray
    offset: float
    slope: float
    bias: float
    share: float  # of toxic documents
    blank: bool = False  # nothing could be learned

    def score(self, text: str | None) -> float:
        """By the worst window; a text without words has the share of toxic documents for a score."""
        worst = -np.inf
        for part in () if self.blank else parts((text or "").encode()):
            g = grams(part)
            if len(g.start):
                worst = max(worst, float(window_means(self.weight, g).max()))
        if not np.isfinite(worst):
            return self.share
        return float(1 / (1 + np.exp(-np.clip(self.slope * (worst + self.offset) + self.bias, -40, 40))))


def window_means(weight: np.ndarray, g: Grams) -> np.ndarray:
    ends = np.append(g.start[1:], len(g.bucket))
    sums = np.concatenate(([0.0], np.cumsum(weight[g.bucket], dtype=np.float64)))
    return (sums[ends] - sums[g.start]) / np.maximum(ends - g.start, 1)


def parts(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """A text in parts that end between words where there are words to end between."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            cut = max(text.rfind(b" ", start, end), text.rfind(b"\n", start, end))
            end = cut + 1 if cut > start else end
        yield text[start:end]
        start = end


def fit(texts: list[str], classes: list[int], share: float | None = None, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """Table and softmax by Adagrad on the log loss; ``texts`` is a bounded sample.

    The first rounds average whole documents. Later ones take, of each document, the window that is worst so far and a
    random one of a clean document: a clean document has to be clean everywhere, a toxic one needs one place. ``share``:
    of toxic documents where the texts come from, if the sample has another.
    """
    y = np.asarray(classes, np.float64)
    if len(set(classes)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0, share=float(y.sum() / (len(y) + 1)), blank=True)
    rng = np.random.default_rng(seed)
    # The driver holds the sample's n-grams once, at two bytes each.
    held_ids, begins, sizes, used = array("H"), [], [], []
    for k, text in enumerate(texts):
        g = grams(text.encode())
        if len(g.start):
            begins.append(g.start + len(held_ids))
            sizes.append(len(g.bucket))
            used.append(k)
            held_ids.frombytes(g.bucket.tobytes())
    if len(set(y[used])) < 2:
        # Of one class at least no text has a word.
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0, share=float(y.mean()) if share is None else share, blank=True)
    y, n = y[used], len(used)
    ids, lengths, starts = np.frombuffer(held_ids, np.uint16), np.array(sizes, np.int64), np.concatenate(begins)
    ends = np.append(starts[1:], len(ids))
    doc = np.repeat(np.arange(n), [len(b) for b in begins])
    first = np.searchsorted(doc, np.arange(n))
    del begins
    held = rng.random(n) < 0.2  # for calibration
    table = rng.normal(0, 0.02, (BUCKETS, WIDTH))
    soft = np.array([-1.0, 1.0])[:, None] * rng.normal(0, 0.3, WIDTH)[None]
    bias = np.zeros(2)
    sums = [np.full((BUCKETS, WIDTH), 1e-6), np.full(WIDTH, 1e-6), 1e-6]
    weight_of = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))

    def means() -> np.ndarray:
        weight, out = table @ (soft[1] - soft[0]), np.empty(len(starts))
        for i in range(0, len(starts), WINDOWS):
            a, b = starts[i : i + WINDOWS], ends[i : i + WINDOWS]
            total = np.concatenate(([0.0], np.cumsum(weight[ids[a[0] : b[-1]]])))
            out[i : i + WINDOWS] = (total[b - a[0]] - total[a - a[0]]) / np.maximum(b - a, 1)
        return out + bias[1] - bias[0]

    for step in range(rounds):
        whole = step < WHOLE
        if not whole:
            now = means()
            worst = np.maximum.reduceat(now, first)
            top = np.flatnonzero(now == worst[doc])
            top = top[np.unique(doc[top], return_index=True)[1]]
        for part in np.array_split(rng.permutation(np.flatnonzero(~held)), max(1, (~held).sum() // 128)):
            if whole:
                spans = [(starts[first[k]], starts[first[k]] + lengths[k], k) for k in part]
            else:
                spans = [(starts[top[k]], ends[top[k]], k) for k in part]
                some = [(k, first[k] + int(rng.integers(np.count_nonzero(doc[first[k] : first[k] + 4096] == k)))) for k in part if y[k] == 0]
                spans += [(starts[w], ends[w], k) for k, w in some]
            spans = [s for s in spans if s[1] > s[0]]
            size = np.array([b - a for a, b, _ in spans])
            of = np.repeat(np.arange(len(spans)), size)
            at = np.concatenate([ids[a:b] for a, b, _ in spans])
            k = np.array([k for _, _, k in spans])
            difference = soft[1] - soft[0]
            logit = np.bincount(of, (table @ difference)[at], len(spans)) / size + bias[1] - bias[0]
            slope = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y[k]) * weight_of[k] / len(spans)
            each = np.bincount(at, (slope / size)[of], BUCKETS)
            seen = np.flatnonzero(each)
            grad_table, grad_soft = each[seen, None] * difference[None] + DECAY * table[seen], each[seen] @ table[seen]
            sums[0][seen] += grad_table**2
            sums[1] += grad_soft**2
            sums[2] += slope.sum() ** 2
            table[seen] -= 0.3 * grad_table / np.sqrt(sums[0][seen])
            move = 0.1 * grad_soft / np.sqrt(sums[1])
            soft[1] -= move
            soft[0] += move
            shift = 0.1 * slope.sum() / np.sqrt(sums[2])
            bias += np.array([shift, -shift])
    worst = np.maximum.reduceat(means(), first)
    some = held if 0 < y[held].sum() < held.sum() else np.ones(len(y), bool)
    slope, add = calibrate(worst[some], y[some])
    if share is None:
        share = float(y.mean())
    # The sample has more toxic texts than the corpus.
    odds = lambda p: np.log(max(p, 1e-6) / max(1 - p, 1e-6))
    add += odds(share) - odds(y[some].mean())
    met = np.zeros(BUCKETS, bool)
    for i in range(0, len(ids), CHUNK):
        met[ids[i : i + CHUNK]] = True
    weight = (table @ (soft[1] - soft[0])) * met
    return Model(weight.astype(np.float32), float(bias[1] - bias[0]), slope, float(add), share)


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic fit by Newton's steps, with a little weight towards one and zero."""
    spread = max(float(np.abs(logit).mean()), 1e-9)
    x = np.stack([logit / spread, np.ones_like(logit)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + 0.05 * (w - np.array([1.0, 0.0]))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3) / spread), float(w[1])


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned; a null id has none."""
    return fold(doc_id, 5) != 0


def sample(docs: DataFrame, labels: DataFrame, label: str, may: Column, rows: int, most_bytes: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts of each class, chosen by a hash of the id; texts above ``most_bytes`` are left out.

    A label that is null, or not 0 or 1, is none; a document labelled both ways counts as labelled 1.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & may)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    # At most 2 * rows ids, so both the list and what it fetches are bounded.
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").where(F.octet_length("text") <= most_bytes)
    # Rows that repeat an id can't make the sample longer than its bound.
    texts = texts.select("doc_id", "text", "y").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(2 * rows)
    return [(r.text, r.y) for r in texts.toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> Model:
    known = sample(docs, labels, "toxic", learnable(F.col("doc_id")), rows, most_bytes)
    share = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    return fit([t for t, _ in known], [y for _, y in known], share)


def _scorer(model, text_col: str, score_col: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        for batch in batches:
            out = pa.array([known.score(t.as_py()) for t in batch[text_col]], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in batch.schema.names if n != score_col), out], [*(n for n in batch.schema.names if n != score_col), score_col])

    return score


def mark(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts, and texts without words, get the calibrated score of no evidence. Repeated rows stay
    repeated. A null id is not held out. Without labels of both classes every score is the share of toxic labels (0 if
    there are none). An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(_scorer(model, "text", "score"), "doc_id long, text string, score double")
    return rows.select(
        "doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


SCORE = "_toxicity"


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    rows = docs.withColumn(SCORE, F.lit(0.0))
    return rows.mapInArrow(_scorer(model, "text", SCORE), rows.schema).where(F.col(SCORE) < 0.5).drop(SCORE)
