"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every term has a random sparse index vector. A term's word vector is the sum of the index vectors of its
neighbours in the learning texts. A word gives two terms: the bucket of its hash, and its shape (letter
case, marks, symbols, length, same as the word before), which stands in for words never seen. A
document is the mean of its words' vectors, fed to a network with one hidden layer, whose
temperature is set on learning rows held back from the fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strikelake.llm.sample import labelled
from strikelake.llm.shared import give_back, schema_with, slices, with_columns
from strikelake.llm.words import Hasher, spans

WORDS, DIMS, ONES, HIDDEN = 1 << 14, 64, 4, 32
SHAPES = 4 * 3 * 3 * 4 * 2
_KIND = np.zeros(256, np.int8)  # 1 capital, 2 other letter or digit, 3 mark, 4 symbol
_KIND[33:127] = 4
_KIND[48:58] = 2
_KIND[97:123] = 2
_KIND[128:] = 2
_KIND[65:91] = 1
_KIND[list(b".,;:?!'\"()-")] = 3


def terms(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, shape and row of every word."""
    starts, ends, rows = spans(data, offsets)
    hashes = hasher.ranges(data, starts, ends)
    kind = _KIND[data]
    number = []
    for k in (1, 2, 3, 4):
        upto = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=upto[1:])
        number.append(upto[ends] - upto[starts])
    capitals, small, marks, symbols = number
    case = np.where(capitals + small == 0, 0, np.where(capitals == 0, 1, np.where(small == 0, 3, 2)))
    case = np.where((case == 3) & (capitals == 1), 2, case)
    size = np.searchsorted([2, 5, 10], ends - starts, "right")
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    shape = (((case * 3 + np.minimum(marks, 2)) * 3 + np.minimum(symbols, 2)) * 4 + size) * 2 + same
    return (hashes >> np.uint64(50)).astype(np.int64), shape, rows


def word_vectors(bucket: np.ndarray, shape: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Context vectors of all terms, word buckets first and shapes after them, scaled to length 1."""
    draw = np.random.default_rng(17)
    index = np.zeros((WORDS + SHAPES, DIMS), np.float32)
    for k in range(ONES):
        index[np.arange(len(index)), draw.integers(0, DIMS, len(index))] += draw.choice([-1, 1], len(index))
    vectors = np.zeros((WORDS + SHAPES, DIMS))
    for lo in range(0, len(rows), 1 << 15):
        a, z = max(0, lo - 2), min(len(rows), lo + (1 << 15) + 2)
        own = index[bucket[a:z]] * 0.25 + index[WORDS + shape[a:z].astype(np.int32)]
        context = np.zeros_like(own)
        for gap in (1, 2):
            near = (rows[a : z - gap] == rows[a + gap : z])[:, None]
            context[gap:] += own[:-gap] * near
            context[:-gap] += own[gap:] * near
        mine = slice(lo - a, min(len(rows), lo + (1 << 15)) - a)
        b, s = bucket[a:z][mine], shape[a:z][mine].astype(np.int32) + WORDS
        for d in range(DIMS):
            vectors[:, d] += np.bincount(b, context[mine, d], len(vectors))
            vectors[:, d] += np.bincount(s, context[mine, d] + own[mine, d], len(vectors))
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(size, 1e-9)).astype(np.float32)


class Quality:
    """Word vectors, network and temperature."""

    def __init__(self, vectors: np.ndarray, centre, scale, layers, temperature: float):
        self.vectors, self.centre, self.scale = vectors, centre, scale
        self.layers, self.temperature = layers, temperature

    def pooled(self, bucket: np.ndarray, shape: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        return pooled(self.vectors, bucket, shape, rows, n)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def pooled(vectors: np.ndarray, bucket, shape, rows, n: int) -> np.ndarray:
    """Per row the mean vector of its words and that of their shapes; zeros without a word."""
    out = np.zeros((n, 2 * DIMS + 1), np.float32)
    count = np.bincount(rows, minlength=n)
    full = np.flatnonzero(count)
    if len(full):
        at = np.concatenate([[0], np.cumsum(count[full])[:-1]])
        step = 1 << 16
        for lo in range(0, len(rows), step):  # rows ascend: partial sums of a run of words
            hi = min(lo + step, len(rows))
            cut = np.concatenate([[lo], at[(at > lo) & (at < hi)]])
            who = rows[cut]
            out[who, :DIMS] += np.add.reduceat(vectors[bucket[lo:hi]], cut - lo)
        seen = np.bincount(rows.astype(np.int64) * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
        out[:, DIMS : 2 * DIMS] = seen @ vectors[WORDS:]
        out /= np.maximum(count, 1)[:, None]
    out[:, -1] = np.log1p(count)
    return out


def _network(x: np.ndarray, y: np.ndarray, steps: int) -> list:
    draw = np.random.default_rng(23)
    params = [
        draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        draw.normal(0, HIDDEN**-0.5, HIDDEN),
        np.zeros(1),
    ]
    mean = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(x @ w1 + b1)
        error = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y) / len(y)
        back = np.outer(error, w2) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * w1, back.sum(0), h.T @ error + 1e-4 * w2, np.array([error.sum()])]
        for i, g in enumerate(grads):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            params[i] = params[i] - 0.01 * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-8)
    return params


def fit(pairs: list[tuple[str, int]], *, steps: int = 300) -> Quality:
    """Fit on (text, 0/1) pairs; every fifth sets the temperature. Without both labels, scores are their share."""
    y = np.array([label for _, label in pairs], float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        width = 2 * DIMS + 1
        layers = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])]
        return Quality(np.zeros((WORDS + SHAPES, DIMS), np.float32), np.zeros(width), np.ones(width), layers, 1.0)
    parts, hasher = [], Hasher(31)
    for lo, data, offsets in slices(pa.array([t for t, _ in pairs], pa.large_string())):
        b, s, r = terms(data, offsets, hasher)
        parts.append((b.astype(np.int16), s.astype(np.int16), (r + lo).astype(np.int32)))
    bucket, shape, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
    vectors = word_vectors(bucket, shape, rows)
    x = pooled(vectors, bucket, shape, rows, len(y)).astype(float)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - centre) / scale
    back = np.arange(len(y)) % 5 == 4
    layers = _network(z[~back], y[~back], steps)
    model = Quality(vectors, centre, scale, layers, 1.0)
    if back.any():
        logits, want = model.logits(x[back]), y[back]
        loss = lambda t: np.logaddexp(0, np.where(want > 0, -logits, logits) / t).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = 5000, max_bytes: int = 100_000) -> Quality:
    """Fit on at most ``rows`` labelled texts of at most ``max_bytes``."""
    return fit(labelled(docs, labels, "quality", rows=rows, max_bytes=max_bytes, by_class=False))


def score(docs: DataFrame, model: Quality, *, text: str = "text") -> DataFrame:
    """All rows with ``score``, 0 to 1. A null text counts as empty, and a text without words gets the
    network's score of no words. Whole texts count. A column ``score`` of the input is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hasher = Hasher(31)
        for batch in batches:
            found = []
            for _, data, offsets in slices(batch.column(text)):
                bucket, shape, rows = terms(data, offsets, hasher)
                found.append(shared.value.scores(shared.value.pooled(bucket, shape, rows, len(offsets) - 1)))
            yield with_columns(batch, score=pa.array(np.concatenate([np.empty(0), *found])))

    return docs.mapInArrow(run, schema_with(docs, score="double"))


def scorer(docs: DataFrame, model: Quality, *, text: str = "text") -> Column:
    """The score as a column: only the text goes to Python, and only numbers come back.

    Null, empty and whole texts count as in :func:`score`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        hasher, found = Hasher(31), []
        for _, data, offsets in slices(column):
            bucket, shape, rows = terms(data, offsets, hasher)
            found.append(shared.value.scores(shared.value.pooled(bucket, shape, rows, len(offsets) - 1)))
            del data, offsets, bucket, shape, rows
        give_back()
        return pa.array(np.concatenate([np.empty(0), *found]))

    return F.arrow_udf(run, "double")(F.col(f"`{text}`"))
