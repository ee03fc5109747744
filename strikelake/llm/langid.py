"""Language identification by error-correcting output codes.

Each language gets a codeword of bits. For every bit a binary n-gram classifier tells the languages
with a one from those with a zero: a linear one, whose weights are the log ratios of how often the two
sides use an n-gram. A text's bits are decoded to the language whose codeword costs least, each bit's
loss weighted by how far apart its two sides are. Counts come from all learning rows; what is gathered is
one number per language and n-gram bucket, whatever the corpus holds.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from strikelake.llm.shared import schema_with, slices, with_columns

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[:65] = 32  # digits, marks and white space up to '@' are one symbol
_LETTER = regex.compile(r"\p{L}")
SHARPNESS = 12.0


def grams(data: np.ndarray, offsets: np.ndarray):
    """For each order: the buckets of all byte n-grams, and the row of each; none crosses rows."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = _LOWER[data]
    value = np.zeros(len(data), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        n = len(data) - order + 1
        if n <= 0:
            return
        value = value[:n] * np.uint32(0x01000193) + code[order - 1 :] * np.uint32(0x9E3779B1) + np.uint32(order)
        hashed = value ^ (value >> np.uint32(15))
        hashed = (hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15)
        whole = rows[:n] == rows[order - 1 :]
        yield hashed[whole], rows[:n][whole]


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A codeword of +1 and -1 per class: all splits in two for up to 5 classes, else well-spread random ones.

    Every bit has both signs, and codewords differ; of many random codes the one with the largest
    least distance is taken.
    """
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = [b for b in itertools.product((1, -1), repeat=n - 1) if -1 in b]
        return np.array([[1, *b] for b in bits], np.int8).T
    draw, best, most = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), (n, length))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, -1, 1).astype(np.int8)[:, None]
        # Of two codewords of +1 and -1 the product is their length less twice what they differ in.
        alike = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(alike, -length)
        near = int(length - alike.max()) // 2
        if near > most:
            best, most = code, near
    return best


def _counts(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """(language, bucket, count) over the rows: each task adds up its own first."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(lang).to_pylist()
            for lo, data, offsets in slices(batch.column(text)):
                labels = names[lo : lo + len(offsets) - 1]
                distinct = sorted(set(labels))
                which = np.array([distinct.index(x) for x in labels])
                for hashed, rows_of in grams(data, offsets):
                    both = np.bincount(which[rows_of] * BUCKETS + hashed, minlength=len(distinct) * BUCKETS)
                    for k, name in enumerate(distinct):
                        totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                        totals[name] += both[k * BUCKETS : (k + 1) * BUCKETS]
        for name, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])],
                names=["lang", "bucket", "count"],
            )

    return rows.mapInArrow(run, "lang string, bucket int, count bigint").groupBy("lang", "bucket").agg(
        F.sum("count").alias("count")
    )


class Codes:
    """Languages, codewords, and the weights of the bits' classifiers."""

    def __init__(self, table: dict[str, np.ndarray]):
        self.names = sorted(table)
        self.code = codewords(len(self.names))
        if not self.names:
            return
        share = np.stack([table[n] / max(table[n].sum(), 1) for n in self.names])  # languages weigh the same
        small = 1e-6
        weights, apart = [], []
        for bit in self.code.T:
            up = share[bit > 0].mean(0) + small
            down = share[bit < 0].mean(0) + small if (bit < 0).any() else up
            weights.append(np.log(up / down))
            apart.append(float(((up - down) * np.log(up / down)).sum()))
        self.weights = np.stack(weights, 1).astype(np.float32)
        self.apart = np.array(apart) / max(sum(apart), 1e-12) if sum(apart) else np.ones(len(apart)) / len(apart)

    def predict(self, data: np.ndarray, offsets: np.ndarray):
        """Per row: nearest language, its score, and whether another is about as near."""
        n = len(offsets) - 1
        total, size = np.zeros((n, self.code.shape[1])), np.zeros(n)
        for hashed, rows in grams(data, offsets):
            size += np.bincount(rows, minlength=n)
            for j in range(total.shape[1]):
                total[:, j] += np.bincount(rows, self.weights[:, j][hashed], n)
        margin = total / np.maximum(size, 1)[:, None]
        # Logistic loss of each bit of each codeword at the text's margins.
        # A bit is either +1 or -1, so both losses of each bit make up those of all codewords.
        plus, minus = (np.log1p(np.exp(-SHARPNESS * sign * margin)) * self.apart for sign in (1, -1))
        loss = plus @ (self.code.T > 0).astype(float) + minus @ (self.code.T < 0).astype(float)
        likely = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        likely /= likely.sum(1, keepdims=True)
        best = likely.argmax(1)
        top = likely[np.arange(n), best]
        return best, top, np.sort(likely, 1)[:, -2:].min(1) > 0.5 * top if len(self.names) > 1 else np.zeros(n, bool)


def learn(rows: DataFrame, *, text: str = "text", lang: str = "lang", most_languages: int = 1000) -> Codes:
    """Codes from all rows with a language. What comes to the driver is languages times buckets at most."""
    known = rows.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    table: dict[str, np.ndarray] = {}
    for batch in _counts(known, "text", "lang").toArrow().to_batches():
        names, buckets, found = (batch.column(c) for c in ("lang", "bucket", "count"))
        names = np.array(names.to_pylist(), object)
        for name in set(names.tolist()):
            mine = names == name
            if name not in table and len(table) == most_languages:
                raise ValueError(f"more than {most_languages} languages")
            table.setdefault(name, np.zeros(BUCKETS))[buckets.to_numpy()[mine]] = found.to_numpy()[mine]
    return Codes(table)


def identify(docs: DataFrame, codes: Codes, *, text: str = "text") -> DataFrame:
    """All rows with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    A null text, one without a letter, or any text when no language was learned is ``und`` with a score
    of 0 and ambiguous. Whole texts count. Ties go to the first language by name. Columns of these
    names in the input are replaced; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        codes = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for lo, data, offsets in slices(batch.column(text)):
                n = len(offsets) - 1
                lettered = np.array([bool(_LETTER.search(t or "")) for t in texts[lo : lo + n]])
                if codes.names:
                    best, score, unsure = codes.predict(data, offsets)
                else:
                    best, score, unsure, lettered = np.zeros(n, int), np.zeros(n), np.ones(n, bool), np.zeros(n, bool)
                names = [codes.names[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                yield with_columns(
                    batch.slice(lo, n),
                    lang_pred=pa.array(names, pa.string()),
                    score=pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0)),
                    ambiguous=pa.array(unsure | ~lettered),
                )

    return docs.mapInArrow(run, schema_with(docs, lang_pred="string", score="double", ambiguous="boolean"))
