"""Encoding, repeated passages, words and counts against their plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from strikelake.llm import bpe, repeats, rules, toxicity
from strikelake.llm.shared import slices, utf8
from strikelake.llm.words import Hasher, shingles, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
MERGES = bpe.Merges(TOKENS)
TIKTOKEN = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=MERGES.rank, special_tokens={}
)
ODD = "abcdeTHE  \n\n\t\r'sd12345.,!éßñ中文 \u0085\x1c 　٣²½😀\x00"


def ids(text: str, encoder=None) -> list[int]:
    encoder = encoder or bpe.Encoder(MERGES, public_tokenizers.PATTERN)
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ODD, max_size=60))
def test_ids_are_those_of_the_library(text):
    assert ids(text) == TIKTOKEN.encode_ordinary(text)


@pytest.mark.parametrize(
    "text", ["", " ", "a" * 5000, "ab" * 3000, " " * 300 + "x", "hello " * 10 + "  ", "aaabaaab" * 200, "\n  x   \n y"]
)
def test_ids_of_hard_texts(text):
    assert ids(text) == TIKTOKEN.encode_ordinary(text)


def test_memory_of_words_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "_MEMORY", 5)
    encoder = bpe.Encoder(MERGES, public_tokenizers.PATTERN)
    draw = random.Random(3)
    for _ in range(50):
        texts = ["".join(draw.choices("ab c.d", k=draw.randint(0, 50))) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [
            TIKTOKEN.encode_ordinary(t) for t in texts
        ]


def test_words_that_come_again_are_not_merged_again(monkeypatch):
    """A full memory keeps what the texts at hand use, and a mark behind a word is no new word."""
    merged, plain = [], bpe.Replay._merged
    monkeypatch.setattr(bpe.Replay, "_merged", lambda self, data, n: merged.append(bytes(data)) or plain(self, data, n))
    monkeypatch.setattr(bpe, "_MEMORY", 3)
    encoder = bpe.Encoder(MERGES, public_tokenizers.PATTERN)
    for text, new in (("x qzxvqj wvkqzz", True), ("y qzxvqj wvkqzz new. wvkqzz,\n\nwvkqzz", False)):
        merged.clear()
        assert ids(text, encoder) == TIKTOKEN.encode_ordinary(text)
        assert (b" qzxvqj" in b"".join(merged)) == (b" wvkqzz" in b"".join(merged)) == new


def test_a_pair_of_lower_rank_that_a_merge_brings_up_comes_first():
    tokens = [bytes([b]) for b in range(256)]
    tokens += [b"bcd", b"ab", b"cd", b"abab"]  # merging c d makes b + cd, which has a lower rank
    merges = bpe.Merges(tokens)
    plain = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=merges.rank, special_tokens={})
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choices("abcd", k=draw.randint(1, 30)))
        got = bpe.Replay(merges).ids([text.encode()])[0].tolist()
        assert got == plain.encode_ordinary(text)


def test_encode_and_decode_rows(spark):
    texts = [None, "", "plain text", "x" * 200_000, "dos\r\n  líneas", "plain text"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, TOKENS, public_tokenizers.PATTERN), TOKENS).collect()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert len(rows) == len(texts)
    assert bpe.encode(docs.limit(0), TOKENS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t", max_size=30), max_size=12), st.integers(1, 40))
def test_words_of_rows(texts, size):
    found = []
    for lo, data, offsets in slices(pa.array(texts, pa.string()), size):
        starts, ends, rows = spans(data, offsets)
        found += [(lo + r, data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows, strict=True)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]


def test_hashes_tell_words_apart_and_shingles_are_sets():
    words = [b"a", b"b", b"ab", b"ba", b"aa", b"a" * 3000, b"ab"]
    data, offsets = utf8(pa.array([b" ".join(words).decode()]))
    starts, ends, rows = spans(data, offsets)
    hashes = Hasher(size=16).ranges(data, starts, ends)
    assert len(set(hashes.tolist())) == 6 and hashes[2] == hashes[6]
    for k, n in ((2, 6), (7, 1), (9, 1)):
        assert len(shingles(hashes, rows, 1, k)[0]) == n
    assert len(shingles(hashes[:0], rows[:0], 1, 4)[0]) == 0


def plain_counts(t: str) -> tuple:
    words = WORD.findall(t)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(three), set()
    for i, w in enumerate(three):
        if often[w] > 1:
            covered.update((i, i + 1, i + 2))
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), repeated, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab #é|\n\t中", max_size=60), min_size=1, max_size=8), st.integers(1, 90))
def test_counts_of_texts(texts, size):
    found = []
    for _, data, offsets in slices(pa.array(texts, pa.string()), size):
        c = rules.counts(data, offsets, Hasher(9))
        found += list(zip(*[c[k].tolist() for k in rules.COUNTS], strict=True))
    assert found == [plain_counts(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_matching_statistics_of_the_index(regions):
    regions = regions + [regions[0]]
    index = repeats.RunIndex(np.frombuffer(b"".join(regions), np.uint8), np.cumsum([len(r) for r in regions]))
    suffixes = [r[i:] for r in regions for i in range(len(r))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = [max(common(a, b) for j, b in enumerate(suffixes) if j != i) if len(suffixes) > 1 else 0
            for i, a in enumerate(suffixes)]
    assert index.statistics().tolist() == want
    assert index.runs <= len(suffixes)


def plain_removed(texts: list[bytes], length: int) -> list[np.ndarray]:
    often = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if often[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 300])
def test_repeated_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    draw = random.Random(11)
    prose = lambda n: "".join(draw.choices("abcdefgé \x00", k=n))
    shared, short = prose(300), prose(90)
    texts = [None, "", "tiny", shared, prose(500), "ab" * 200, "x" * 400]
    texts += [prose(draw.randint(0, 80)) + shared[draw.randint(0, 90) :] + prose(50) for _ in range(12)]
    texts += [prose(60) + short + prose(60) for _ in range(12)] + [texts[4], texts[4]]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, kept long")
    found = {r.doc_id: r for r in repeats.remove_repeats(docs, length=100).collect()}
    raw = [(t or "").encode() for t in texts]
    assert len(found) == len(texts)
    for i, gone in enumerate(plain_removed(raw, 100)):
        lo, hi = repeats._runs(gone)
        assert (found[i].span_lo, found[i].span_hi) == (lo, hi), i
        assert bytes(found[i].kept) == np.frombuffer(raw[i], np.uint8)[~gone].tobytes()


def test_windows_of_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "_PIECE", 64)
    data = np.frombuffer(random.Random(2).randbytes(1000), np.uint8)
    start, count, place, _, _ = repeats.windows(data, 100, Hasher(3))
    covered = np.concatenate([np.arange(s, s + c) for s, c in zip(start, count, strict=True)])
    assert covered.tolist() == list(range(901))
    assert (place >= 0).all() and (place - count + 1 >= -100).all()


def test_repeats_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, length=8)


def test_toxic_scores_are_those_of_distinct_features():
    pairs = [(f"some quiet words {i}", 0) for i in range(30)] + [(f"you Foul beast {i}", 1) for i in range(30)]
    model = toxicity.fit(pairs)
    texts = ["", "a", "you FOUL beast", "quiet", "é" * 50, "yo", "u foul"] * 3
    got = model.scores(texts)
    sums = [model.weight[toxicity.features(t)].sum() + model.bias for t in texts]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(sums))), atol=1e-5)
    assert np.allclose([model.scores([t])[0] for t in texts], got)
    assert got[2] > 0.5 > got[3]


def test_every_bucket_that_tells_something_has_a_weight():
    """30 kinds of toxic words, 20 texts of each, among 400 plain words: no list of features is cut off."""
    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(draw.choices(letters, k=7))
    plain, foul = [word() for _ in range(400)], [word() for _ in range(30)]
    talk = lambda: " ".join(draw.choices(plain, k=30))
    pairs = [(f"{talk()} {talk()}", 0) for _ in range(600)] + [(f"{talk()} {foul[i % 30]} {talk()}", 1) for i in range(600)]
    model = toxicity.fit(pairs)
    told = np.zeros(toxicity.BUCKETS, int)
    for text, label in pairs:
        told[toxicity.features(text)] += 2 * label - 1
    assert np.count_nonzero(model.weight[told != 0]) >= 0.99 * np.count_nonzero(told)
    held = [f"{talk()} {talk()}" for _ in range(200)] + [f"{talk()} {f} {talk()}" for f in foul * 4]
    found = model.scores(held) >= 0.5
    assert found[200:].mean() > 0.9 and found[:200].mean() < 0.1


def test_sha_of_kept_bytes_matches(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "né")], "doc_id long, text string")
    row = repeats.remove_repeats(docs).select(F.sha2("kept", 256).alias("h")).first()
    assert row.h == hashlib.sha256("né".encode()).hexdigest()
