"""License scans, the Merkle manifest and conversation repair against their plain definitions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strikelake.llm import dialogue, licenses, merkle
from strikelake.llm.queries import QUERIES, damaged
from strikelake.llm.shared import ranked

# --- licenses ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
TALK = ["under", "the", "mit", "license", "Apache", "License,", "version", "2", "CC-BY", "NC", "é", "½", "(", "--", "\n"]


def base_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    words = WORD.findall(text.translate(LOWER))
    found = []
    for phrase, label in licenses.BASE.items():
        k = phrase.split()
        found += [(i, label) for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k]
    return len(words), sorted(found)


def scanned(text: str) -> licenses.Found:
    return licenses.Scanner().scan(np.frombuffer(text.encode(), np.uint8))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(TALK), st.sampled_from([" ", "  ", "-", ""])), max_size=20), st.sampled_from([1, 3, 8, 1 << 20]))
def test_base_phrases_are_found_wherever_pieces_end(parts, piece):
    text, whole = "".join(a + b for a, b in parts), licenses.PIECE
    licenses.PIECE = piece
    try:
        found = scanned(text)
    finally:
        licenses.PIECE = whole
    assert (found.n_words, sorted(found.base)) == base_places(text)


@pytest.mark.parametrize(
    ("text", "terms", "score"),
    [
        ("SPDX-License-Identifier: MIT", "mit", 0.2),
        ("License: MIT OR GPL-3.0-only AND MIT", "mit gpl-3.0-only mit and or", 0.2),
        ("license = (MIT OR GPL-3.0) AND AGPL-3.0+", "mit gpl-3.0 or agpl-3.0+ and", 0.8),
        ("license: GPL-2.0 WITH Classpath-exception-2.0 AND MIT", "gpl-2.0 classpath-exception-2.0 with mit and", 0.4),
        ("license: MIT OR LicenseRef-own", "mit licenseref-own or", 0.2),
        ("license: MIT AND LicenseRef-own", "mit licenseref-own and", 1.0),
        ("license: ((MIT", "mit", 0.2),
        ("license: MIT) OR GPL-3.0", "mit", 0.2),
        ("license: MIT OR\nGPL-3.0", "mit", 0.2),
        ("license: MIT/ISC or", "mit isc or", 0.2),
    ],
)
def test_expressions(text, terms, score):
    found = scanned(text)
    assert [e[1] for e in found.expressions] == [terms]
    assert found.score() == score


@pytest.mark.parametrize("text", ["license: see below", "license MIT", "a license", "license: ()", "license:", "spdx license identifier"])
def test_tags_without_a_known_license_say_nothing(text):
    assert scanned(text).expressions == []


def test_the_longest_notice_of_a_place_counts():
    found = scanned("the GNU General Public License, version 3, or CC BY-SA; CC BY")
    assert [label for _, label in found.notices] == ["gpl-3", "cc-by-sa", "cc-by"]


def test_licenses_of_a_table(spark):
    texts = [None, "", "-- ", "Under the MIT License. " * 3, "x " * 300_000 + "CC BY-NC", "no words of it"]
    rows = [(i, t, "kept", i) for i, t in enumerate(texts)] + [(3, texts[3], "kept", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, labels string, `a b` bigint")
    got = sorted(licenses.scan(docs).collect(), key=lambda r: r["doc_id"])
    assert [r["n_words"] for r in got] == [0, 0, 0, 12, 12, 300_003, 4]
    assert [r["n_base"] for r in got] == [0, 0, 0, 3, 3, 1, 0]
    assert [(r["first_word"], r["last_word"]) for r in got][3:] == [(0, 8), (0, 8), (300_000, 300_000), (None, None)]
    assert [r["labels"] for r in got] == ["", "", "", "mit", "mit", "cc-by-nc", ""]
    assert licenses.scan(docs.limit(0)).collect() == []


def test_op11_against_its_definition(spark, tmp_path):
    draw = random.Random(5)
    texts = [" ".join(draw.choices(TALK, k=draw.randint(0, 60))) for _ in range(200)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op11_licenses"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, places = base_places(text or "")
        starts = [w for w, _ in places]
        want = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want
        assert set(filter(None, want[4].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1


# --- Merkle manifest ---


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def value(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels: list[list[str]], at: int) -> list[str]:
    out = []
    for level in levels[:-1]:
        run = at - at % 8
        out += [h for i, h in enumerate(level[run : run + 8], run) if i != at]
        at //= 8
    return out


def manifest(rows: list[tuple]) -> dict[tuple, set]:
    """(leaf) -> {(subroot, root, digest of its proof)} by the definition."""
    groups: dict = {}
    for doc_id, source, lang, n, text in rows:
        leaf = sha("".join(map(value, (doc_id, source, lang, n, text))))
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: climb([x[2] for x in sorted(groups[lang])]) for lang in order}
    top = climb([trees[lang][-1][0] for lang in order])
    out: dict = {}
    for k, lang in enumerate(order):
        for at, leaf in enumerate(trees[lang][0]):
            proof = sha("".join(beside(trees[lang], at) + beside(top, k)))
            out.setdefault(leaf, set()).add((trees[lang][-1][0], top[-1][0], proof))
    return out


TABLE = "doc_id bigint, source string, lang string, n_chars bigint, text string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def proven(spark, rows, extra=()):
    docs = spark.createDataFrame(rows, TABLE)
    for name in extra:
        docs = docs.withColumn(name, F.lit("own"))
    found = merkle.prove(docs, COLUMNS)
    proof = F.sha2(merkle.siblings(F.col("path")), 256).alias("proof")
    return found.select("leaf", "subroot", "root", proof, merkle.fold(F.col("leaf"), F.col("path")).alias("back")).collect()


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "fr": 64}, {"en": 513, None: 65, "de": 1, "ü": 520}, {f"l{i}": 2 for i in range(70)}])
def test_manifest_equals_its_definition(spark, sizes):
    rows = [(i, None if i % 5 else "s", lang, i * i, f"Text {i} é") for lang, n in sizes.items() for i in range(n)]
    want, got = manifest(rows), proven(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["subroot"], r["root"], r["proof"]) in want[r["leaf"]]
        assert r["back"] == r["root"]


def test_manifest_of_nulls_repeats_and_odd_columns(spark):
    rows = [(1, "s", "en", 3, "abc")] * 20 + [(None, None, None, None, None), (2, "", "", 0, ""), (3, "s", "en", None, "x" * 200_000)]
    got = proven(spark, rows, extra=("g", "hash", "pos", "record", "_pos"))
    want = manifest(rows)
    assert sorted((r["subroot"], r["root"]) for r in got) == sorted(
        next(iter(want[sha("".join(map(value, row)))]))[:2] for row in rows
    )
    assert {r["proof"] for r in got} == {x[2] for v in want.values() for x in v}
    assert all(r["back"] == r["root"] for r in got)
    assert proven(spark, []) == []


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(100)], TABLE)
    found = merkle.prove(docs, COLUMNS)
    other = found.select((merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("same"))
    assert other.filter("same").count() == 0


def test_places_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else None, i % 50) for i in range(3000)]
    got = ranked(spark.createDataFrame(rows, "g string, o bigint").repartition(7), ["g"], ["o"], "test").collect()
    for _, own in groupby(sorted(got, key=lambda r: (r["g"] or "", r["_pos"])), key=lambda r: r["g"]):
        own = list(own)
        assert [r["_pos"] for r in own] == list(range(len(own)))
        assert [r["o"] for r in own] == sorted(r["o"] for r in own)
        assert {r["_total"] for r in own} == {len(own)}


# --- conversations ---

TAKES = {("s", "-"): "s", ("u", "-"): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
NEXT = {"-": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits by search; rows are (initial, must go, cut short)."""
    heap, seen = [(0, "", 0, "-")], set()
    while True:
        cost, letters, i, state = heapq.heappop(heap)
        if i == len(rows) and state in "-a":
            return cost, letters
        if (i, state) in seen:
            continue
        seen.add((i, state))
        heapq.heappush(heap, (cost + 3, letters + "I", i, NEXT[state]))
        if i < len(rows):
            initial, gone, short = rows[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state))
            if not gone:
                heapq.heappush(heap, (cost + 3 + 3 * short, letters + "R", i + 1, NEXT[state]))
                if (initial, state) in TAKES:
                    heapq.heappush(heap, (cost + 3 * short, letters + "K", i + 1, TAKES[initial, state]))


def repaired(rows: list[tuple]) -> tuple:
    """The result of one conversation, rows being (turn, role, text) in their order."""
    seen, kinds, blank, again, short = set(), [], 0, 0, 0
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "again" if (role, text) in seen else "short" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, again, short = blank + (fault == "blank"), again + (fault == "again"), short + (fault == "short")
        kinds.append((role[:1], fault in ("blank", "again"), fault == "short"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, letters = cheapest(kinds)
    lines, state, i = [], "-", 0
    for x in letters:
        turn = {"u": "user", "a": "assistant"}[NEXT[state]]
        if x == "I":
            lines.append(f"{turn}:")
            state = NEXT[state]
            continue
        _, role, text = rows[i]
        i += 1
        if x == "K":
            lines.append(f"{role}:{text}")
            state = role[0]
        elif x == "R":
            lines.append(f"{turn}:{text}")
            state = NEXT[state]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, blank, again, short, illegal, cost, letters, sha("\n".join(lines))


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(rows: list[tuple]) -> dict:
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    given: dict = {}
    for r in rows:
        given.setdefault(r[0], []).append((r[0], r[1], *(" " if x is None else x for x in r[2:])))
    return {k: repaired([x[1:] for x in sorted(v, key=key)]) for k, v in given.items()}


def test_block_tables_equal_a_search():
    table, draw = dialogue.Tables(), random.Random(11)
    for _ in range(1500):
        symbols = [draw.randrange(9) for _ in range(draw.randrange(16))]
        rows = [("sua-"[x // 2] if x < 8 else "u", x == 8, x < 8 and x % 2 == 1) for x in symbols]
        vector, cost, state = table.effect(np.array(symbols, np.int64))
        letters, q = table.letters_of(np.array(symbols, np.int64), 0, 0)
        assert (cost[0] + table.vectors[vector[0]][0], letters + dialogue._LAST[q]) == cheapest(rows)
        assert state[0][0] == q


@pytest.mark.parametrize("piece", [3, 4096])
def test_conversations_equal_a_search(spark, piece, monkeypatch):
    monkeypatch.setattr(dialogue, "PIECE", piece)
    draw = random.Random(piece)
    texts = ["Hello there.", "Cut off", " \n", "", "Why? ", "Yes!", "x" * 50_000 + ".", None, "…"]
    roles = ["user", "assistant", "system", "tool", None, ""]
    rows = [
        (c if c else None, draw.choice([None, *range(9)]), draw.choices(roles, [5, 5, 2, 1, 1, 1])[0], draw.choice(texts))
        for c in range(60)
        for _ in range(draw.randrange(12))
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    table = table.withColumn("conv", F.lit(1)).withColumn("_pos", F.lit("own"))
    ids = spark.createDataFrame([(x,) for x in [None, *range(1, 60), 777]], "conv_id bigint")
    got = {r["conv_id"]: tuple(r[c] for c in RESULT) for r in dialogue.repair(table, ids).collect()}
    want = by_conversation(rows)
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got == {k: want.get(k, empty) for k in [None, *range(1, 60), 777]}
    assert dialogue.repair(table.limit(0)).collect() == []


def test_op13_against_its_definition(spark, tmp_path):
    draw = random.Random(7)
    rows = [
        (c, t, draw.choice(["user", "assistant", "system"]), draw.choice(["Hm.", "So? Yes", "a. b", "No!", " "]))
        for c in range(80)
        for t in range(draw.randrange(1, 9))
    ]
    rows.append((900, 13, "user", "gone"))
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    harmed = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        harmed += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {r["conv_id"]: tuple(r[c] for c in RESULT) for r in QUERIES["op13_conversations"](spark, str(tmp_path)).collect()}
    want = by_conversation(harmed)
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got == {c: want.get(c, empty) for c in {r[0] for r in rows}}
    assert damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).count() == len(harmed)
