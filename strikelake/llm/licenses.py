"""License scans: notice phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

A text is lower-cased and reduced to its words with one space between, and one automaton over all
phrases and tags runs through that, piece by piece, so that its state alone is carried through a long
text. Behind a tag (``SPDX-License-Identifier:``, ``license =``) stands an expression, which is read from
the text itself: a shunting-yard turns it into postfix order, where ``with`` binds closer than ``and`` and
that closer than ``or``, and its value is how far it restricts use: the lesser of an ``or``, the greater
of an ``and``, and with a linking exception no more than a weak copyleft.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strikelake.llm.shared import schema_with, utf8, with_columns

PIECE = 1 << 20

# The phrases of the contract and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Phrases of common notices and the labels they give. Of phrases in one place the longest counts.
NOTICES = {
    "the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "the apache license": "apache",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "redistribution and use in source and binary forms": "bsd",
    "the isc license": "isc",
    "this is free and unencumbered software": "unlicense",
    "dedicated to the public domain": "public-domain",
    "cc0 1 0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}

TAGS = ("spdx license identifier", "license", "licence", "license expression")

# How far a family of licenses restricts use: 0 not at all, 1 altogether. Those of the first table have
# their major version in the label.
VERSIONED = {"apache": 0.2, "gpl": 0.7, "lgpl": 0.4, "agpl": 0.8, "mpl": 0.4, "epl": 0.4}
PLAIN = {
    "0bsd": 0.1, "bsd": 0.2, "bsl": 0.2, "mit": 0.2, "isc": 0.2, "zlib": 0.2, "unlicense": 0.1, "cc0": 0.1,
    "public-domain": 0.1, "cc-by": 0.3, "cc-by-sa": 0.5, "cc-by-nd": 0.8, "cc-by-nc": 0.9, "cc-by-nc-sa": 0.9,
    "cc-by-nc-nd": 0.9, "proprietary": 1.0, "all-rights-reserved": 1.0,
}
EXCEPTION = 0.4

_TABLE = np.full(256, 32, np.uint8)
_TABLE[48:58] = np.arange(48, 58)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)
_IDENTIFIER = re.compile(
    r"(?P<family>" + "|".join(sorted([*VERSIONED, *PLAIN], key=len, reverse=True)) + r")(?:-v?(?P<major>\d+)[\w.-]*)?\Z"
)
_OPEN = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(rb"[ \t]*([()/]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def identifier(name: str) -> tuple[str, float] | None:
    """Label and restriction of a license identifier; None for one that is not known."""
    plain = re.sub(r"(\+|-only|-or-later)\Z", "", name.lower().rstrip("."))
    found = _IDENTIFIER.match(plain)
    if found is None:
        return None
    family, major = found["family"], found["major"]
    if family in VERSIONED:
        return (f"{family}-{major}" if major else family), VERSIONED[family]
    return family, PLAIN[family]


def postfix(text: bytes, at: int) -> list[str]:
    """The expression at a place, in postfix order; it goes on while it makes sense, in the same line.

    An operator without a right side is left out, an open bracket closes at the end, and a closing one
    that nothing opened ends the expression.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, waiting = True, None
    opened = 0
    while (found := _TOKEN.match(text, at)) is not None:
        token = found[1].decode().lower().rstrip(".")
        token = "or" if token == "/" else token
        if operand:
            if token in _BINDS or token in (")", ""):
                break
            if waiting is not None:
                while stack and _BINDS.get(stack[-1], 0) >= _BINDS[waiting]:
                    out.append(stack.pop())
                stack.append(waiting)
                waiting = None
            if token == "(":
                stack.append(token)
                opened += 1
            else:
                out.append(token)
                operand = False
        elif token == ")":
            if not opened:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            opened -= 1
        elif token in _BINDS:
            waiting, operand = token, True
        else:
            break
        at = found.end()
    ends = [x for x in reversed(stack) if x != "("]
    return out + ends


def evaluate(terms: list[str]) -> tuple[float, list[str]] | None:
    """Restriction and labels of a postfix expression; None where it names no known license.

    An unknown identifier restricts altogether: it is chosen of an ``or`` only where the other side
    restricts as much, and decides an ``and``.
    """
    stack: list[float] = []
    labels: list[str] = []
    names = iter(terms)
    for k, term in enumerate(names):
        if term not in _BINDS:
            exception = k + 1 < len(terms) and terms[k + 1] == "with"
            known = None if exception else identifier(term)
            if known is not None:
                labels.append(known[0])
            stack.append(known[1] if known is not None else 1.0)
            continue
        if len(stack) < 2:
            continue  # what an empty bracket leaves
        right, left = stack.pop(), stack.pop()
        stack.append({"or": min(left, right), "and": max(left, right), "with": min(left, EXCEPTION)}[term])
    return (stack[-1], labels) if labels else None


@dataclass
class Found:
    """What a text holds: words, places of base phrases, and what the other phrases and tags say."""

    n_words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)
    notices: list[tuple[int, str]] = field(default_factory=list)
    expressions: list[tuple[int, str, float, list[str]]] = field(default_factory=list)

    def score(self) -> float:
        """The most that anything in the text restricts its use; 0 without a license."""
        own = [identifier(label) for _, label in self.base + self.notices]
        return max([0.0, *[x[1] for x in own if x is not None], *[e[2] for e in self.expressions]])


class Scanner:
    """One automaton over all phrases, told apart by what they are: base, notice or tag."""

    def __init__(self, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, tags: tuple[str, ...] = TAGS):
        self.machine = ahocorasick.Automaton()
        meanings: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(tags, ""))):
            for phrase, label in phrases.items():
                words = bytes(_TABLE[np.frombuffer(phrase.encode(), np.uint8)]).split()
                if words:
                    meanings.setdefault(b" ".join(words).decode("latin-1"), []).append((kind, label))
        for phrase, meaning in meanings.items():
            self.machine.add_word(f" {phrase} ", (phrase.count(" ") + 1, meaning))
        if meanings:
            self.machine.make_automaton()

    def places(self, data: np.ndarray):
        """(first word, words, end in the text, meanings) of every phrase; last (words in all, 0, end, None)."""
        words, fed, gap = 0, 1, True
        search = self.machine.iter(" ") if len(self.machine) else iter(())
        for _ in search:
            pass
        for lo in range(0, len(data), PIECE):
            piece = _TABLE[data[lo : lo + PIECE]]
            space = piece == 32
            again = np.concatenate([[gap], space[:-1]]) & space
            kept = piece[~again]
            hits = self._fed(search, kept)
            if hits:
                at, ended = np.flatnonzero(~again), np.cumsum(kept == 32)
                for end, (k, meaning) in hits:
                    yield words + int(ended[end - fed]) - k, k, lo + int(at[end - fed]), meaning
            words, fed, gap = words + int((kept == 32).sum()), fed + len(kept), bool(space[-1])
        if not gap:
            words += 1
            for _, (k, meaning) in self._fed(search, np.full(1, 32, np.uint8)):
                yield words - k, k, len(data), meaning
        yield words, 0, len(data), None

    def _fed(self, search, kept: np.ndarray) -> list:
        if not len(self.machine):
            return []
        search.set(kept.tobytes().decode("latin-1"))
        return list(search)

    def scan(self, data: np.ndarray) -> Found:
        found, spans, text = Found(), [], None
        for first, k, end, meaning in self.places(data):
            if meaning is None:
                found.n_words = first
                break
            for kind, label in meaning:
                if kind == "base":
                    found.base.append((first, label))
                if kind != "tag":
                    spans.append((first, -k, kind, label))
                    continue
                text = data.tobytes() if text is None else text
                opened = _OPEN.match(text, end)
                terms = postfix(text, opened.end()) if opened else []
                value = evaluate(terms)
                if value is not None:
                    found.expressions.append((first, " ".join(terms), *value))
        upto = -1
        for first, k, kind, label in sorted(spans):
            if kind == "notice" and first - k > upto:
                found.notices.append((first, label))
            upto = max(upto, first - k)
        return found


def _joined(labels) -> str:
    return ",".join(sorted(set(labels)))


_COLUMNS = {
    "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
    "labels": "string", "score": "double", "expressions": "array<string>",
}


def scan(docs: DataFrame, *, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, text: str = "text") -> DataFrame:
    """All rows without their text, with what it says of licenses.

    ``n_base`` places hold a base phrase, the first and the last at ``first_word`` and ``last_word`` (null
    without any); ``base_labels`` and ``labels`` are distinct, sorted and joined by commas, the second with
    what notices and expressions add. ``score`` is the most that any of them restricts use (0 without
    a license, 1 all rights reserved); ``expressions`` are those behind tags, in postfix order. Whole texts
    count; a null text is empty and has no words. Repeated rows stay, an empty table gives no rows,
    and columns of these names in the input are replaced.
    """

    def run(batches):
        scanner = Scanner(base, notices)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            found = [scanner.scan(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            words = [[w for w, _ in f.base] for f in found]
            columns = {
                "n_words": [f.n_words for f in found],
                "n_base": [len(w) for w in words],
                "first_word": [min(w, default=None) for w in words],
                "last_word": [max(w, default=None) for w in words],
                "base_labels": [_joined(x for _, x in f.base) for f in found],
                "labels": [
                    _joined([x for _, x in f.base + f.notices] + [x for e in f.expressions for x in e[3]]) for f in found
                ],
                "score": [f.score() for f in found],
                "expressions": [[e[1] for e in f.expressions] for f in found],
            }
            kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
            arrays = {n: pa.array(v, kinds[_COLUMNS[n]]) for n, v in columns.items()}
            yield with_columns(batch, drop=(text,), **arrays)

    return docs.mapInArrow(run, schema_with(docs, drop=(text,), **_COLUMNS))
