"""Byte-level BPE encoding and decoding by merge replay over a corpus of distinct words.

The words of a batch of texts form one corpus, each distinct word once. An inverted index leads from a
token pair to the places where it stands; merges are applied in rank order to all words at once,
and only the neighbours of a merged pair are looked at again. A word's ids depend on the word
alone, so batches need nothing of each other, no data is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strikelake.llm.shared import give_back, schema_with, slices, with_columns

_MEMORY = 300_000  # distinct words whose ids a task remembers; a speed-up, results don't depend on it
_MARKS = frozenset(".,;:!?")


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Merges:
    """A vocabulary and the rank of every pair of its tokens that together make a token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens)}
        pairs = [
            (self.rank[t[:k]] * len(tokens) + self.rank[t[k:]], r)
            for r, t in enumerate(tokens)
            for k in range(1, len(t))
            if t[:k] in self.rank and t[k:] in self.rank
        ]
        keys, ranks = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.keys, self.ranks = np.ascontiguousarray(keys), ranks.astype(np.int32)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


class Replay:
    """The merges of a vocabulary, applied to a set of words at once."""

    def __init__(self, merges: Merges):
        self.merges = merges
        single = merges.single
        pairs = merges.of(np.repeat(single, 256), np.tile(single, 256))
        self.first = pairs.reshape(256, 256)
        self.whole = {b"": b""} | {t: r.to_bytes(4, "little") for t, r in merges.rank.items()}

    def ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word. A word that is a token is that token."""
        return [np.frombuffer(x, "<u4").astype(np.int32) for x in self.coded(words)]

    def coded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        out = list(map(self.whole.get, words))
        todo = [i for i, x in enumerate(out) if x is None]
        if todo:
            merged = [words[i] for i in todo]
            lengths = np.fromiter(map(len, merged), np.int64, len(merged))
            token = self._merged(np.frombuffer(b"".join(merged), np.uint8), lengths)
            alive = token >= 0
            cuts = (4 * np.cumsum(alive)[np.cumsum(lengths) - 1]).tolist()
            data = token[alive].astype("<u4").tobytes()
            for i, lo, hi in zip(todo, [0, *cuts[:-1]], cuts, strict=True):
                out[i] = data[lo:hi]
        return out

    def _merged(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens at the places where they begin, -1 elsewhere."""
        n, of = len(data), self.merges.of
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        ends = np.cumsum(lengths)
        token = self.merges.single[data]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = n  # n: nothing follows
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - lengths] = -1
        pair = np.full(n + 1, -1, np.int32)  # rank of the pair that begins at a place
        pair[: n - 1] = self.first[data[:-1], data[1:]]
        pair[ends - 1] = -1
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True) if len(ranks) else ():
                r = int(ranks[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(at[a:b])

        enter(np.arange(n, dtype=np.int32))
        while queue:
            r = heapq.heappop(queue)
            found = places.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            at = at[pair[at] == r]
            if len(at) > 1 and (word[at[1:]] == word[at[:-1]]).any():
                at, later = self._together(at, r, token, after, before, word)
                if len(later):
                    places[r] = [later]
                    heapq.heappush(queue, r)
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            token[at], token[gone], pair[gone] = r, -1, -1
            after[at] = far
            before[far[far < n]] = at[far < n]
            left = before[at]
            left = left[left >= 0]
            pair[at] = -1
            right = at[far < n]
            pair[right] = of(token[right], token[after[right]])
            pair[left] = of(token[left], token[after[left]])
            enter(np.unique(np.concatenate([left, right])))
        return token

    def _together(self, at, r, token, after, before, word) -> tuple[np.ndarray, np.ndarray]:
        """Of several places in a word, those to merge now and those to look at again.

        Places that overlap are taken from the left. Where a merge could bring up a pair of a lower
        rank, which comes first, only the word's leftmost place is merged now.
        """
        n = len(token)
        chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
        start = np.maximum.accumulate(np.where(chained, -1, np.arange(len(at))))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        far = after[after[at]]
        new = np.full(len(at), r, np.int32)
        low = np.zeros(len(at), bool)
        for has, a, b in (
            (far < n, new, token[np.minimum(far, n - 1)]),
            (before[at] >= 0, token[before[at]], new),
            (np.ones(len(at), bool), new, new),
        ):
            ranks = self.merges.of(a, b)
            low |= has & (ranks >= 0) & (ranks < r)
        leftmost = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
        now = leftmost | ~np.isin(word[at], word[at[low]])
        return at[now], at[~now]


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    The pattern never matches across a space that a non-space follows, so texts are cut in front of
    each of those, and equal cuts are split by the pattern and encoded once.
    """

    def __init__(self, merges: Merges, pattern: str):
        self.replay = Replay(merges)
        self.pattern = regex.compile(pattern)
        self.inner: dict[str, bytes] = {}  # by what follows the space
        self.odd = regex.compile(r" (?:\s|\Z)")

    def _learn(self, heads: set[str], fresh: list[str]) -> dict[str, bytes]:
        """Ids of text beginnings. Those of ``fresh``, what follows a space, are remembered."""
        inner = self.inner
        # A space and letters are one match, and so is a mark alone behind them.
        plain = [c for c in fresh if c.isalpha()]
        inner.update(zip(plain, self.replay.coded([(" " + c).encode() for c in plain]), strict=True))
        rest = [c for c in fresh if not c.isalpha()]
        split = [
            (" " + c[:-1], c[-1]) if c[-1:] in _MARKS and c[:-1].isalpha() else self.pattern.findall(" " + c)
            for c in rest
        ]
        firsts = list(heads)
        split += map(self.pattern.findall, firsts)
        # A match that begins with a space may be a cut that is known.
        of = {m: inner.get(m[1:]) if m[0] == " " else None for ms in split for m in ms}
        words = [m for m, x in of.items() if x is None]
        of.update(zip(words, self.replay.coded([m.encode() for m in words]), strict=True))
        ids = [b"".join(map(of.__getitem__, ms)) for ms in split]
        inner.update(zip(rest, ids, strict=False))
        return dict(zip(firsts, ids[len(rest) :], strict=True))

    def _cuts(self, text: str) -> tuple[str, list[str]]:
        """The text up to the first cut, then what follows the space of each cut."""
        out = text.split(" ")
        if self.odd.search(text):
            # A space in front of a white space or the end belongs to the cut before it.
            joined, run = [], [out[0]]
            for c in out[1:]:
                if c == "" or c[0].isspace():
                    run.append(c)
                else:
                    joined.append(" ".join(run))
                    run = [c]
            joined.append(" ".join(run))
            out = joined
        return out.pop(0), out

    def encode(self, texts: list[str]) -> list[bytes]:
        # A word is held once, however often it comes: what stands where are numbers.
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        heads, places = [], []
        for t in texts:
            head, cs = self._cuts(t)
            heads.append(head)
            places.append(np.fromiter(map(numbers.__getitem__, cs), np.int32, len(cs)))
        used = list(numbers)
        del numbers
        fresh = [c for c in used if c not in self.inner]
        if len(self.inner) + len(fresh) > _MEMORY:
            # What comes again is the likeliest to come once more.
            self.inner = {c: self.inner[c] for c in used if c in self.inner}
        first = self._learn(set(heads), fresh)
        ids = list(map(self.inner.__getitem__, used))
        return [first[head] + b"".join(map(ids.__getitem__, p.tolist())) for head, p in zip(heads, places, strict=True)]


def _parts(batch: pa.RecordBatch, column: str, size: int):
    """The batch in runs of rows of about ``size`` bytes in a column, so that few are unpacked at once."""
    for lo, _, offsets in slices(batch.column(column), size):
        yield batch.slice(lo, len(offsets) - 1)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, *, text: str = "text") -> DataFrame:
    """All rows with ``ids``: the text's token ids as little-endian unsigned 32-bit numbers.

    Each match of ``pattern`` is encoded by itself, without special tokens. A null or empty text has no
    ids. Whole texts of any length are encoded. ``tokens`` is a vocabulary, of fixed size, and is
    broadcast. A column ``ids`` of the input is replaced.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Merges(tokens))

    def run(batches):
        encoder = Encoder(vocabulary.value, pattern)
        for batch in batches:
            for part in _parts(batch, text, 6 << 20):
                texts = [t or "" for t in part.column(text).to_pylist()]
                yield with_columns(part, ids=pa.array(encoder.encode(texts), pa.binary()))
                del texts
        del encoder
        give_back()

    return docs.mapInArrow(run, schema_with(docs, ids="binary"))


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """All rows with ``decoded``, the bytes that their ``ids`` stand for. Null ids give null."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        table = vocabulary.value
        for batch in batches:
            for part in _parts(batch, "ids", 1 << 20):
                texts = [
                    None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist()))
                    for x in part.column("ids").to_pylist()
                ]
                yield with_columns(part, decoded=pa.array(texts, pa.binary()))
        give_back()

    return encoded.mapInArrow(run, schema_with(encoded, decoded="binary"))
