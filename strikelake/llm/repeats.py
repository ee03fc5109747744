"""Removal of long passages that occur more than once, with run-compressed indexes.

Every window of ``length`` bytes is represented by its minimizer, the 32 bytes in it with the smallest
hash: equal windows have equal minimizers at equal places. Windows in a row with the same minimizer are
one *region*, and equal regions are counted as one with a weight. Only minimizers that occur twice
anywhere can hold a repeated window; the distinct regions around them are brought together by minimizer
and indexed:

* the suffixes of the regions are sorted and their Burrows-Wheeler transform is cut into runs;
* at the two ends of a run, the match of a suffix with its neighbour in the order is measured on the
  text and kept as a sample;
* matching statistics of all regions are streamed from the samples: inside a run a match is one byte
  shorter than that of the position before. Starts that match ``length`` bytes elsewhere are repeated.

The runs, not the text, decide how many matches are measured, which suits repetitive corpora.
Passages are judged on the input and never cross rows, so the index of a minimizer is all its windows
need. A minimizer with too much text around it for one index is split: windows are grouped by how far
their minimizer lies from their start, ever more finely, and keyed by all the bytes that the windows of
such a group share; at the finest level that is the window itself, and its copies are one weighted region.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strikelake.llm.shared import give_back, schema_with, slices, store, with_columns
from strikelake.llm.words import Hasher, mix

SEED_BYTES = 32
BUCKET, HOT = 2 << 20, 512 << 10
LEVELS = (16, 1)
_PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def _minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every window of ``width`` values."""
    n = len(values)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def windows(data: np.ndarray, length: int, hasher: Hasher):
    """Regions of one text: start, number of windows, place of the minimizer, its hash, the region's hash."""
    parts = []
    for at in range(0, len(data) - length + 1, _PIECE):
        piece = data[at : at + _PIECE + length - 1]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(hasher.table[piece] * hasher.power[: len(piece)], out=total[1:])
        n = len(piece) - SEED_BYTES + 1
        seeds = mix((total[SEED_BYTES:] - total[:-SEED_BYTES]) * hasher.inverse[:n])
        least = _minimum((seeds & ~_PLACE) | np.arange(n, dtype=np.uint64), length - SEED_BYTES + 1)
        place = (least & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([start, [len(place)]]))
        end = start + count - 1 + length
        whole = mix((total[end] - total[start]) * hasher.inverse[start] + (end - start).astype(np.uint64))
        parts.append((start + at, count, place[start] - start, seeds[place[start]], whole))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _occurrences(rows: DataFrame, length: int) -> DataFrame:
    def run(batches):
        hasher = Hasher(3)
        for batch in batches:
            for lo, data, offsets in slices(batch.column("_text")):
                ids = batch.column("_row").slice(lo, len(offsets) - 1).to_numpy()
                found = [windows(data[a:b], length, hasher) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                start, count, place, seed, whole = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(start):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids, [len(x[0]) for x in found])),
                            pa.array(start),
                            pa.array(count.astype(np.int32)),
                            pa.array(place.astype(np.int32)),
                            pa.array(seed.view(np.int64)),
                            pa.array(whole.view(np.int64)),
                        ],
                        names=["_row", "start", "n", "place", "key", "whole"],
                    )
            del batch
        give_back()

    return rows.select("_row", "_text").mapInArrow(
        run, "_row bigint, start bigint, n int, place int, key bigint, whole bigint"
    )


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a few regions, and their matching statistics.

    ``text`` holds the regions one after the other, ``ends`` where each ends. Suffixes end with their
    region; of equal ones the earlier region's is smaller. Places and ranks are 32-bit numbers.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray):
        self.text, self.n = text, len(text)
        begins = np.concatenate([[0], ends[:-1]])
        sizes = ends - begins
        left = np.repeat(ends, sizes).astype(np.int32) - np.arange(self.n, dtype=np.int32)
        order = self._sorted(left, int(sizes.max(initial=0)))
        before = np.empty(self.n, np.int16)
        before[1:] = text[:-1]
        before[begins[sizes > 0]] = -1
        transform = before[order]
        new = np.ones(self.n, bool)
        new[1:] = (transform[1:] != transform[:-1]) | (transform[1:] < 0)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], self.n) - 1
        # Samples: the first suffix of a run with the one before it, the last with the one after it.
        self.runs = len(heads)
        self.samples = []
        for mine, other in ((heads, heads - 1), (tails, tails + 1)):
            inside = (other >= 0) & (other < self.n)
            length = np.zeros(len(mine), np.int64)
            length[inside] = self._match(order[mine[inside]], order[other[inside]], left)
            self.samples.append((order[mine], length))

    def _sorted(self, left: np.ndarray, longest: int) -> np.ndarray:
        """Suffixes in order: by their first 7 bytes, then by doubling what is compared among ties."""
        n, text = self.n, np.concatenate([self.text, np.zeros(8, np.uint8)])
        if not n:
            return np.empty(0, np.int32)
        key = np.zeros(n, np.uint64)
        for j in range(7):
            key <<= np.uint64(8)
            key |= np.where(left > j, text[j : j + n], np.uint8(0))
        key <<= np.uint64(8)
        key |= np.minimum(left, 7).astype(np.uint8)
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        first = np.zeros(n, np.int32)
        first[1:] = np.where(key[1:] != key[:-1], np.arange(1, n, dtype=np.int32), 0)
        del key
        rank = np.zeros(n + 1, np.int32)
        rank[order] = np.maximum.accumulate(first) + 1
        del first
        h = 7
        while h < longest:
            at_rank = rank[order]
            tied = np.concatenate([at_rank[1:] == at_rank[:-1], [False]])
            del at_rank
            tied[1:] |= tied[:-1].copy()
            where = np.flatnonzero(tied).astype(np.int32)
            if not len(where):
                break
            mine = order[where]
            two = rank[mine].astype(np.int64) << 32
            two |= np.where(left[mine] > h, rank[np.minimum(mine + h, n)], 0)
            by = np.argsort(two)
            order[where] = mine[by]
            two = two[by]
            del mine, by
            fresh = np.concatenate([[True], two[1:] != two[:-1]])
            del two
            rank[order[where]] = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where), dtype=np.int32), 0))] + 1
            h *= 2
        by = rank[order].astype(np.int64) << 32
        by |= order
        order = order[np.argsort(by)]
        return order

    def _match(self, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, within their regions."""
        text = np.concatenate([self.text, np.zeros(8, np.uint8)])
        words = np.ndarray(self.n + 1, "<u8", text, strides=(1,)) if self.n else np.empty(0, np.uint64)
        limit = np.minimum(left[a], left[b])
        out = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        at = 0
        while len(going):
            x = words[np.minimum(a[going] + at, self.n)] ^ words[np.minimum(b[going] + at, self.n)]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            out[going] = np.minimum(at + same, limit[going])
            going = going[(x == 0) & (at + 8 < limit[going])]
            at += 8
        return out

    def statistics(self) -> np.ndarray:
        """Longest match of the suffix at each place with any other suffix, streamed from the samples."""
        best, place = np.zeros(self.n, np.int32), np.arange(self.n, dtype=np.int32)
        for at, length in self.samples:
            value = np.full(self.n, -1, np.int32)
            value[at] = length
            last = np.maximum.accumulate(np.where(value >= 0, place, 0))
            np.maximum(best, value[last] - (place - last), out=best)
        return best


def _runs(marked: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


_FOUND = "key bigint, whole bigint, lo array<int>, hi array<int>"


def _indexed(regions: DataFrame, length: int) -> DataFrame:
    """(key, whole, lo, hi): runs of repeated window starts of each region, by an index per bucket of keys."""
    size = regions.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("key"), F.lit(1 + size // BUCKET)).alias("bucket")

    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("body").combine_chunks().to_pylist()
        ends = np.cumsum([len(b) for b in bodies])
        matches = RunIndex(np.frombuffer(b"".join(bodies), np.uint8), ends).statistics()
        counts, weights = table.column("n").to_pylist(), table.column("weight").to_pylist()
        lo, hi = [], []
        for b, e, n, w in zip(bodies, ends, counts, weights, strict=True):
            at = e - len(b)
            a, z = _runs((matches[at : at + n] >= length) | (w > 1))
            lo.append(a)
            hi.append(z)
        del bodies, matches
        give_back()
        return pa.table(
            [table.column("key"), table.column("whole"), pa.array(lo, pa.list_(pa.int32())), pa.array(hi, pa.list_(pa.int32()))],
            names=["key", "whole", "lo", "hi"],
        )

    columns = regions.select(bucket, "key", "whole", "n", "weight", "body")
    found = columns.groupBy("bucket").applyInArrow(run, _FOUND)
    return found.filter(F.size("lo") > 0)


def _split(regions: DataFrame, length: int, step: int) -> DataFrame:
    """The windows of hot regions in groups of ``step`` neighbouring places of the minimizer."""

    def run(batches):
        hasher = Hasher(4, 1 << 12)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "whole", "weight", "n", "place", "body")]
            out = []
            for key, whole, weight, n, place, body in zip(*cols, strict=True):
                data = np.frombuffer(body, np.uint8)
                for j in range((place - n + 1) // step, place // step + 1):
                    first, last = max(0, place - (j + 1) * step + 1), min(n - 1, place - j * step)
                    a, z = np.array([place - j * step, first]), np.array([place - (j + 1) * step + 1, last]) + length
                    common, part = (int(hasher.ranges(data, a[i : i + 1], z[i : i + 1]).view(np.int64)[0]) for i in (0, 1))
                    mark = int(mix(np.array([common ^ (j + 1)], np.int64).view(np.uint64)).view(np.int64)[0])
                    out.append((key, whole, weight, first, last - first + 1, place - first, mark, part, body[first : last + length]))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.binary()]
            names = ["of_key", "of_whole", "weight", "start", "n", "place", "key", "whole", "body"]
            data = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, kinds, strict=True)], names=names)
            del batch, cols, out, data
        give_back()

    return regions.select("key", "whole", "weight", "n", "place", "body").mapInArrow(
        run,
        "of_key bigint, of_whole bigint, weight bigint, start int, n int, place int, key bigint, whole bigint, body binary",
    )


def _repeated(regions: DataFrame, length: int, levels: tuple[int, ...]) -> DataFrame:
    """(key, whole, lo, hi) of regions whose minimizer occurs twice or more."""
    heavy = regions.groupBy("key").agg(F.sum(F.octet_length("body")).alias("bytes"), F.count("*").alias("m"))
    hot = store(heavy.filter((F.col("bytes") > HOT) & (F.col("m") > 1)).select("key"), "repeat-hot")
    if not levels or hot.isEmpty():
        return _indexed(regions, length)
    plain = _indexed(regions.join(hot, "key", "left_anti"), length)
    parts = store(_split(regions.join(hot, "key"), length, levels[0]), "repeat-parts")
    again = parts.groupBy("key").agg(F.sum("weight").alias("w")).filter("w > 1").select("key")
    again = store(again, "repeat-keys")
    distinct = (
        parts.join(again, "key")
        .groupBy("key", "whole")
        .agg(F.sum("weight").alias("weight"), *[F.first(c).alias(c) for c in ("n", "place", "body")])
    )
    found = store(_repeated(store(distinct, "repeat-regions"), length, levels[1:]), "repeat-found")
    shift = lambda c: F.flatten(F.collect_list(F.transform(c, lambda x: x + F.col("start")))).alias(c)
    back = parts.join(found, ["key", "whole"]).groupBy("of_key", "of_whole").agg(shift("lo"), shift("hi"))
    return plain.unionByName(
        back.select(F.col("of_key").alias("key"), F.col("of_whole").alias("whole"), "lo", "hi")
    )


def remove_repeats(docs: DataFrame, *, length: int = 400, text: str = "text") -> DataFrame:
    """All rows with ``kept``, the bytes that stay, for the text; ``span_lo`` and ``span_hi``, the maximal removed runs.

    A byte goes if a string of ``length`` bytes around it also starts anywhere else, in the same text
    or another; overlaps count, and strings are judged on the input. Texts are taken as UTF-8 bytes,
    whole, a null one as empty; shorter ones keep all. Rows may repeat; a repeated row is a repeat.
    Columns of these names in the input are replaced. No rows give no rows.
    """
    if length < SEED_BYTES:
        raise ValueError(f"length must be at least {SEED_BYTES}")
    others = [c for c in docs.columns if c not in (text, "kept", "span_lo", "span_hi")]
    record = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("_record")
    row = F.monotonically_increasing_id().alias("_row")
    rows = store(docs.select(row, record, F.col(text).alias("_text")), "repeat-rows")
    every = store(_occurrences(rows, length), "repeat-windows")
    again = store(every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "repeat-keys")
    places = store(every.join(again, "key"), "repeat-places")
    first = F.min(F.struct("_row", "start")).alias("first")
    regions = places.groupBy("key", "whole").agg(
        F.count("*").alias("weight"), F.first("n").alias("n"), F.first("place").alias("place"), first
    )
    wanted = regions.groupBy(F.col("first._row").alias("_row")).agg(
        F.collect_list(F.struct("key", "whole", "weight", "n", "place", F.col("first.start").alias("at"))).alias("cut")
    )
    body = F.expr(
        f"""inline(transform(cut, x -> struct(x.key, x.whole, x.weight, x.n, x.place,
        substring(_bytes, cast(x.at + 1 AS int), x.n + {length - 1}) AS body)))"""
    )
    source = rows.select("_row", F.col("_text").cast("binary").alias("_bytes"))
    texts = store(source.join(wanted, "_row").select(body).toDF("key", "whole", "weight", "n", "place", "body"), "repeat-regions")
    found = store(_repeated(texts, length, LEVELS), "repeat-found")
    shift = lambda c: F.flatten(F.collect_list(F.transform(c, lambda x: x + F.col("start")))).alias(c)
    marks = places.join(found, ["key", "whole"]).groupBy("_row").agg(shift("lo"), shift("hi"))

    def run(batches):
        for batch in batches:
            kept, spans_lo, spans_hi = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("_bytes", "lo", "hi")]
            for body, lo, hi in zip(*columns, strict=True):
                if not lo:
                    kept.append(body)
                    spans_lo.append([])
                    spans_hi.append([])
                    continue
                edge = np.zeros(len(body) + 1, np.int32)
                np.add.at(edge, lo, 1)
                np.add.at(edge, np.array(hi) + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
                a, z = _runs(gone)
                spans_lo.append(a)
                spans_hi.append(z)
            yield with_columns(
                batch,
                ("lo", "hi", "_row", "_bytes"),
                kept=pa.array(kept, pa.binary()),
                span_lo=pa.array(spans_lo, pa.list_(pa.int64())),
                span_hi=pa.array(spans_hi, pa.list_(pa.int64())),
            )
            del batch, columns, kept
        give_back()

    whole = rows.withColumn("_bytes", F.coalesce(F.col("_text").cast("binary"), F.lit(b""))).drop("_text")
    marked = whole.join(marks, "_row", "left")
    schema = schema_with(
        marked, ("lo", "hi", "_row", "_bytes"), kept="binary", span_lo="array<bigint>", span_hi="array<bigint>"
    )
    cleaned = marked.mapInArrow(run, schema)
    field = F.col("_record").getField
    return cleaned.select(*[field(c).alias(c) for c in others], "kept", "span_lo", "span_hi")
