"""Near-duplicate groups whose members are edited copies of one text, against all pairs."""

from __future__ import annotations

import random

import pytest

from strikelake.llm import setsketch

VOCABULARY = [f"w{i}" for i in range(40)]


def edited(n: int, edits: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            at = draw.randrange(len(words))
            words[at : at + draw.randint(0, 2)] = [draw.choice(VOCABULARY)] * draw.randint(0, 2)
        out.append(" ".join(words[draw.choice([0, 0, 0, 9]) :]))
    return out


def components(texts: list[str], k: int = 4) -> list[int]:
    sets = []
    for t in texts:
        words = t.split()
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("n", "edits", "rounds"), [(150, 9, 2), (150, 14, 0), (100, 25, 1)])
def test_edited_copies_equal_all_pairs(spark, n, edits, rounds, monkeypatch):
    monkeypatch.setattr(setsketch, "ROUNDS", max(1, rounds))
    texts = edited(n, edits, n + edits)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in setsketch.near_groups(docs, words=4).collect()}
    assert [got[i] for i in range(n)] == components(texts)


def test_pairs_grow_with_a_hot_group(spark, monkeypatch):
    counts, last = [], setsketch._last_pairs

    def counted(*args):
        links, pairs = last(*args)
        counts[-1] += pairs.count()
        return links, pairs

    monkeypatch.setattr(setsketch, "_last_pairs", counted)
    for n in (200, 400):
        counts.append(0)
        docs = spark.createDataFrame(list(enumerate(edited(n, 12, 3))), "doc_id bigint, text string")
        setsketch.near_groups(docs, words=4).count()
    # All pairs of those that no leader is linked to and the others would be a multiple of this.
    assert counts[1] <= 3 * max(counts[0], n)
