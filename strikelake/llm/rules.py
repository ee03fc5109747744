"""Quality rules: counts over words and lines, and robust multivariate outliers per language and source.

The method's verdict rests on the minimum-covariance-determinant estimate of each (language, source):
centre and spread of the three quarters of its documents that lie closest together, found by
concentration steps from three starts, of which the least determinant counts. A document goes when its
transformed statistics lie too far out by Mahalanobis distance. Estimates come from all documents by
sums that every task adds up on its own, so a hot source is no trouble.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strikelake.llm.shared import schema_with, slices, store, with_columns
from strikelake.llm.words import GAP, Hasher, mix, spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
# Transformed statistics: log words, log characters per word, and square roots of the shares of
# symbols, repeated lines, repeated words and capitals. The squares of these are added to every
# estimate's variances, as statistics without any spread have no inverse. A share's root may differ by
# 1, so a floor has to stay far below sqrt(1 / CUTOFF) = 0.17 for its statistic to reject by itself.
FLOORS = (0.1, 0.04, 0.035, 0.08, 0.08, 0.04)
DIMS = len(FLOORS)
SHARE, STEPS = 0.75, 3
# Chi-square of 6 degrees of freedom at 0.99999, and what a spread of the inner 75 % is to be multiplied by.
CUTOFF, CONSISTENCY = 33.1, 1.55
PRIOR = 20  # pooled documents mixed into each group's estimate


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys have occurred before."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def counts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> dict[str, np.ndarray]:
    """The counts of each row of a run of texts, and its capitals and lines with a word."""
    n = len(offsets) - 1
    rows_of = np.repeat(np.arange(n), np.diff(offsets))
    per_row = lambda mask: np.bincount(rows_of[mask], minlength=n)
    starts, ends, rows = spans(data, offsets)
    n_words = np.bincount(rows, minlength=n)
    inside = ~GAP[data]
    words = hasher.ranges(data, starts, ends)
    seed = np.uint64(0x2545F4914F6CDD1D)
    tail = max(0, len(words) - 2)
    three = mix(mix(mix(words[:tail]) * seed + words[1 : tail + 1]) * seed + words[2 : tail + 2])
    whole = rows[:tail] == rows[2 : tail + 2]
    three = mix(three + rows[:tail].astype(np.uint64) * seed)
    again = np.zeros(tail, bool)
    again[whole] = _repeats(three[whole])
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : j + tail] |= again
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))[: len(line_start)]
    line_end = line_end - (data[line_end - 1] == 10)  # a line ends before its break, or with its row
    upto = np.concatenate([[0], np.cumsum(inside)])
    real = upto[line_end] > upto[line_start]
    line_start, line_end = line_start[real], line_end[real]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = mix(hasher.ranges(data, line_start, line_end) + line_row.astype(np.uint64) * seed)
    return {
        "n_words": n_words,
        "word_chars": per_row(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": np.bincount(rows_of, _SYMBOL[data], n).astype(np.int64),
        "n_dup_lines": np.bincount(line_row[_later(lines)], minlength=n),
        "n_repeat_words": np.bincount(rows[covered], minlength=n),
        "_capitals": per_row((data >= 65) & (data <= 90)),
        "_lines": np.bincount(line_row, minlength=n),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows without their text, with the counts and the transformed statistics ``_x0`` to ``_x5``."""

    def run(batches):
        hasher = Hasher(9)
        for batch in batches:
            for lo, data, offsets in slices(batch.column(text)):
                c = counts(data, offsets, hasher)
                words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
                x = (
                    np.log(words),
                    np.log(chars / words),
                    np.sqrt(c["n_symbols"] / chars),
                    np.sqrt(c["n_dup_lines"] / np.maximum(c["_lines"], 1)),
                    np.sqrt(c["n_repeat_words"] / words),
                    np.sqrt(c["_capitals"] / chars),
                )
                yield with_columns(
                    batch.slice(lo, len(offsets) - 1),
                    (text,),
                    **{k: pa.array(c[k].astype(np.int64)) for k in COUNTS},
                    **{f"_x{i}": pa.array(v) for i, v in enumerate(x)},
                )

    kinds = dict.fromkeys(COUNTS, "bigint") | {f"_x{i}": "double" for i in range(DIMS)}
    return docs.mapInArrow(run, schema_with(docs, (text,), **kinds))


_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _covariance(n: float, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    full = np.zeros((DIMS, DIMS))
    for (i, j), v in zip(_PAIRS, products, strict=True):
        full[i, j] = full[j, i] = v / n
    return full - np.outer(sums, sums) / n**2


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(f"_x{i}") for i in range(DIMS)]
    return rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        F.array(*[F.sum(c) for c in x]).alias("sums"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("products"),
    )


def _inverted(moments: DataFrame) -> DataFrame:
    """Centre, inverse spread and log determinant of each group and start, mixed with its start's pooled ones."""
    moments = store(moments, "rules-moments")
    parts = [F.sum(F.col("sums")[i]) for i in range(DIMS)] + [F.sum(F.col("products")[i]) for i in range(len(_PAIRS))]
    totals = moments.groupBy("_start").agg(
        F.sum("n").alias("n"), F.array(*parts[:DIMS]).alias("s"), F.array(*parts[DIMS:]).alias("p")
    )
    pooled = {}
    for row in totals.collect():  # one row per start
        sums = np.array(row["s"], float)
        pooled[row["_start"]] = sums / row["n"], _covariance(row["n"], sums, np.array(row["p"], float))
    least = np.diag(np.square(FLOORS))

    def run(batches):
        for batch in batches:
            means, inverses, sizes = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("_start", "n", "sums", "products")]
            for start, n, sums, products in zip(*columns, strict=True):
                centre, spread = pooled[start]
                own = np.array(sums)
                mean = (own + PRIOR * centre) / (n + PRIOR)
                cov = (n * _covariance(n, own, np.array(products)) + PRIOR * spread) / (n + PRIOR)
                full = CONSISTENCY * cov + least
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(full).ravel().tolist())
                sizes.append(float(np.linalg.slogdet(full)[1]))
            kind = pa.list_(pa.float64())
            yield with_columns(
                batch,
                ("n", "sums", "products"),
                _mean=pa.array(means, kind),
                _inverse=pa.array(inverses, kind),
                _logdet=pa.array(sizes, pa.float64()),
            )

    kinds = {"_mean": "array<double>", "_inverse": "array<double>", "_logdet": "double"}
    ddl = schema_with(moments, ("n", "sums", "products"), **kinds)
    return store(moments.mapInArrow(run, ddl), "rules-estimates")


def _starts(good: DataFrame, names: list[str]) -> DataFrame:
    """Three starts of each group: medians with median deviations or alone, means with deviations."""
    middle = lambda c: F.percentile_approx(c, 0.5, 1000)
    x = [F.col(f"_x{i}") for i in range(DIMS)]
    centres = good.groupBy(*names).agg(
        F.array(*[middle(c) for c in x]).alias("_mean"),
        F.array(*[F.avg(c) for c in x]).alias("_average"),
        F.array(*[F.stddev_pop(c) for c in x]).alias("_deviation"),
    )
    centres = store(centres, "rules-medians")
    deviations = _near(good, centres, names).groupBy(*names).agg(
        F.array(*[1.4826 * middle(F.abs(c - F.col("_mean")[i])) for i, c in enumerate(x)]).alias("_off")
    )

    def start(number: int, mean: str, scale: str | None) -> F.Column:
        floors = [F.lit(f) for f in FLOORS]
        wide = [F.greatest(F.col(scale)[i], f) if scale else f for i, f in enumerate(floors)]
        flat = [1 / (wide[i] * wide[i]) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS)]
        return F.struct(F.lit(number).alias("_start"), F.col(mean).alias("_mean"), F.array(*flat).alias("_inverse"))

    each = F.array(start(0, "_mean", "_off"), start(1, "_mean", None), start(2, "_average", "_deviation"))
    table = _near(centres, deviations, names).select(*names, F.explode(each).alias("_s"))
    return store(table.select(*names, "_s.*"), "rules-start")


def _near(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with a group table's columns; null keys match one another."""
    same = [rows[k].eqNullSafe(table[k]) for k in keys]
    return rows.join(table, same, "left").drop(*[table[k] for k in keys])


def _distance() -> F.Column:
    gap = [F.col(f"_x{i}") - F.col("_mean")[i] for i in range(DIMS)]
    terms = [gap[i] * gap[j] * F.col("_inverse")[i * DIMS + j] * (1 if i == j else 2) for i, j in _PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def judge(docs: DataFrame, *, keys: tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """All rows without their text, with the counts, ``base_failed``, ``distance`` and ``kept``.

    The base fails a text of fewer than 50 words, or with over half of its words in 3-word windows that
    it has twice. Null and empty texts have zero counts and fail it; so they and others that fail
    take no part in the estimates, and have no distance. Null languages and sources are groups of
    their own. Small groups lean on the pooled estimate. No rows give no rows. Columns of these names,
    ``_x0`` to ``_x5`` included, are the operator's own.
    """
    names = list(keys)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = store(measure(docs, text).withColumn("base_failed", failed), "rules-counts")
    good = rows.filter("NOT base_failed").select(*names, *[f"_x{i}" for i in range(DIMS)])
    estimate, keys = _starts(good, names), [*names, "_start"]
    tried = good.withColumn("_start", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    for _ in range(STEPS):
        measured = _near(tried, estimate, keys).withColumn("_d2", _distance())
        within = measured.groupBy(*keys).agg(F.percentile_approx("_d2", SHARE, 1000).alias("_limit"))
        inner = _near(measured, store(within, "rules-limits"), keys).filter("_d2 <= _limit")
        estimate = _inverted(_moments(inner, keys))
    least = F.min_by(F.struct("_mean", "_inverse"), F.struct("_logdet", "_start")).alias("_best")
    estimate = store(estimate.groupBy(*names).agg(least).select(*names, "_best.*"), "rules-best")
    final = _near(rows, estimate, names)
    distance = F.when(~F.col("base_failed"), F.sqrt(_distance()))
    kept = ~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= math.sqrt(CUTOFF))
    drop = [f"_x{i}" for i in range(DIMS)] + ["_mean", "_inverse"]
    return final.withColumn("distance", distance).withColumn("kept", kept).drop(*drop)
