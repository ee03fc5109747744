"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams that a text has, lower-cased. Each is scaled by the log
ratio of its share of toxic and of other texts, and a logistic regression is fitted on the scaled features,
all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strikelake.llm.sample import labelled
from strikelake.llm.shared import schema_with, with_columns

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
PRIOR = 5.0
_PIECE = 1 << 20


def _lowered(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint32)


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    value = np.full(n, order, np.uint32)
    for j in range(order):
        value = (value ^ codes[j : j + n]) * np.uint32(0x85EBCA6B)
        value ^= value >> np.uint32(13)
    return ((value * np.uint32(0xC2B2AE35)) >> np.uint32(14)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of the text's n-grams, of all of it."""
    codes = _lowered(text)
    return np.unique(np.concatenate([_buckets(codes, k) for k in ORDERS])).astype(np.int32)


class Toxicity:
    """A weight per bucket: log-count ratio times regression weight."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        """Per text; buckets count once each, however often and where they stand."""
        out = np.full(len(texts), self.bias)
        has = np.zeros(BUCKETS, np.float32)
        for i, text in enumerate(texts):
            codes = _lowered(text)
            found = [_buckets(codes, k) for k in ORDERS]
            for b in found:
                has[b] = 1
            out[i] += has @ self.weight
            for b in found:
                has[b] = 0
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


class _Rows:
    """Sparse rows of scaled features, each the ratio of a bucket that its text has.

    Products are worked out some rows at a time, so that no temporary is as large as all features.
    """

    def __init__(self, found: list[np.ndarray], ratio: np.ndarray):
        sizes = np.array([len(f) for f in found])
        self.n, self.full = len(sizes), np.flatnonzero(sizes)
        self.sizes = sizes[self.full]
        self.bucket = np.concatenate(found)
        self.value = ratio.astype(np.float32)[self.bucket]
        ends = np.cumsum(self.sizes)
        self.parts, at = [], 0
        while at < len(ends):
            lo = int(ends[at] - self.sizes[at])
            to = max(at + 1, int(np.searchsorted(ends, lo + _PIECE, "right")))
            self.parts.append((at, to, lo, int(ends[to - 1])))
            at = to

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for at, to, lo, hi in self.parts:
            products = self.value[lo:hi] * w[self.bucket[lo:hi]]
            starts = np.cumsum(self.sizes[at:to]) - self.sizes[at:to]
            out[self.full[at:to]] = np.add.reduceat(products, starts)
        return out

    def back(self, error: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for at, to, lo, hi in self.parts:
            spread = np.repeat(error[self.full[at:to]].astype(np.float32), self.sizes[at:to])
            out += np.bincount(self.bucket[lo:hi], self.value[lo:hi] * spread, BUCKETS)
        return out.astype(np.float32)


def log_count_ratio(toxic: np.ndarray, other: np.ndarray, n: float, m: float) -> np.ndarray:
    """Log ratio of a bucket's share of toxic and of other texts, against what both have together.

    ``PRIOR`` texts more at the common share count in either, so that a bucket tells nothing until enough
    texts have it, however many of the two sorts were given.
    """
    seen = toxic + other
    most, rest = seen * n / (n + m), seen * m / (n + m)
    return np.log((toxic + PRIOR) / (most + PRIOR)) - np.log((other + PRIOR) / (rest + PRIOR))


def fit(pairs: list[tuple[str, int]], *, steps: int = 80, ridge: float = 1e-4) -> Toxicity:
    """Fit on (text, 0/1) pairs, over all buckets. Without both labels, every score is their share (0.5 if none).

    Accelerated gradient descent on the logistic loss, both labels weighing the same, with steps as
    long as its curvature allows.
    """
    y = np.array([label for _, label in pairs], float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Toxicity(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    found = [features(t) for t, _ in pairs]
    toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for f, label in zip(found, y, strict=True):
        (toxic if label else other)[f] += 1
    n, m = y.sum(), len(y) - y.sum()
    ratio = log_count_ratio(toxic, other, n, m)
    rows = _Rows(found, ratio)
    del found
    weigh = np.where(y > 0, 0.5 / n, 0.5 / m)
    w, b = np.abs(ratio).astype(np.float32), 1.0
    for _ in range(8):  # the largest curvature, by powers
        size = np.sqrt((w * w).sum() + b * b)
        w, b = w / size, b / size
        error = (rows.times(w) + b) * weigh
        w, b = rows.back(error), float(error.sum())
    step = 1 / (0.25 * 1.1 * np.sqrt((w * w).sum() + b * b) + ridge)
    w, b = np.zeros(BUCKETS, np.float32), 0.0
    last_w, last_b = w, b
    for t in range(1, steps + 1):
        ahead = (t - 1) / (t + 2)
        v, c = w + ahead * (w - last_w), b + ahead * (b - last_b)
        error = (1 / (1 + np.exp(-np.clip(rows.times(v) + c, -30, 30))) - y) * weigh
        last_w, last_b = w, b
        w, b = (v - step * (rows.back(error) + ridge * v)).astype(np.float32), c - step * error.sum()
    return Toxicity((w * ratio).astype(np.float32), float(b))


def learn(
    docs: DataFrame, labels: DataFrame, *, rows: int = 6000, max_bytes: int = 100_000, total_bytes: int = 16 << 20
) -> Toxicity:
    """Fit on at most ``rows`` labelled texts of at most ``max_bytes``, half of either label at most.

    Of an id with several labels the highest counts. Texts are taken in the order of a hash of their id
    until they have ``total_bytes``, which bounds what the driver holds while it fits; both labels
    come in that order alike.
    """
    pairs = labelled(docs, labels, "toxic", rows=rows, max_bytes=max_bytes, by_class=True)
    sizes = np.cumsum([len(t.encode()) for t, _ in pairs])
    return fit(pairs[: int(np.searchsorted(sizes, total_bytes, "right"))])


def score(docs: DataFrame, model: Toxicity, *, text: str = "text") -> DataFrame:
    """All rows with ``score``, 0 to 1. A null text counts as empty, and an empty one gets the model's
    score of a text without features. Whole texts count. A column ``score`` of the input is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield with_columns(batch, score=pa.array(shared.value.scores(texts)))

    return docs.mapInArrow(run, schema_with(docs, score="double"))
