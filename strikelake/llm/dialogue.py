"""Repair of conversation structure by Four-Russians block tables.

A conversation's rows are symbols: role, and whether the row must go or is cut short. The cheapest edits
that make its roles alternate follow from a vector per place, the cost to the end from each of four states:
nothing said yet, after the system, after the user, after the assistant. Less its minimum such a vector
takes few values, so what a block of four symbols does to each of them is tabulated once: the vector
before the block, the cost it adds, and the state in which the cheapest edits leave it. Costs are then
looked up block by block from the end, and edits traced from the start, each block being expanded
backward from the vector behind it. Of equally cheap edits the one whose initials come first is taken,
which the costs to the end decide one letter at a time.

Long conversations are cut into pieces of 4096 rows. A piece's table lookups give its effect as a
function, of some hundred bytes; per conversation only those are brought together and chained. Texts
are last streamed through the digest in order, one conversation after the other, and none is gathered.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strikelake.llm.shared import ranked, store

PIECE, WIDTH = 4096, 4
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
# States: 0 nothing, 1 after the system, 2 after the user, 3 after the assistant. What each takes next.
_TURN = (2, 2, 3, 2)
_TAKES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_END = (0, 2 * INSERT, INSERT, 0)
_LAST = ("", "II", "I", "")
# Symbols: role 0 system, 1 user, 2 assistant, 3 other, twice for whole and cut short; 8 must go.
_ROLES, _GONE = "sua-", 8
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_FIGURES = ("blank", "duplicate", "truncated", "illegal", "cost")


def _actions(after: tuple, symbol: int) -> list[list[tuple[str, int, int]]]:
    """Per state what may be done with a row, in letter order: (letter, next state, cost to the end)."""
    out = []
    for q in range(4):
        found = [("D", q, DELETE + after[q])]
        if symbol != _GONE:
            extra = CUT * (symbol % 2)
            kept = _TAKES[q].get(_ROLES[symbol // 2])
            if kept is not None:
                found.append(("K", kept, KEEP + extra + after[kept]))
            found.append(("R", _TURN[q], REROLE + extra + after[_TURN[q]]))
        out.append(found)
    return out


def _before(after: tuple, symbol: int) -> tuple:
    """Costs to the end ahead of a row, with up to two rows inserted before it (a third leads back)."""
    done = [min(cost for _, _, cost in found) for found in _actions(after, symbol)]
    once = [min(done[q], INSERT + done[_TURN[q]]) for q in range(4)]
    return tuple(min(done[q], INSERT + once[_TURN[q]]) for q in range(4))


def _trace(after: tuple, symbol: int, q: int) -> tuple[str, int]:
    """The letters up to and with the row's own, the first in letter order of the cheapest; the next state."""
    actions, costs, letters = _actions(after, symbol), _before(after, symbol), ""
    while True:
        best = {letter: state for letter, state, cost in actions[q] if cost == costs[q]}
        if "D" not in best and INSERT + costs[_TURN[q]] == costs[q]:
            letters, q = letters + "I", _TURN[q]
            continue
        letter = min(best)
        return letters + letter, best[letter]


class Tables:
    """All vectors that occur, and what a symbol and a block of ``WIDTH`` symbols do to each.

    There are 30 vectors and 6561 blocks whatever the data: some 1.6 MB, broadcast once.
    """

    def __init__(self):
        self.vectors, known = [_END], {_END: 0}
        rows = []
        for vector in self.vectors:  # grows while it is walked
            row = []
            for symbol in range(9):
                costs = _before(vector, symbol)
                least = min(costs)
                norm = tuple(c - least for c in costs)
                if norm not in known:
                    known[norm] = len(self.vectors)
                    self.vectors.append(norm)
                row.append((known[norm], least, [_trace(vector, symbol, q) for q in range(4)]))
            rows.append(row)
        self.to = np.array([[x[0] for x in row] for row in rows], np.int64)
        self.add = np.array([[x[1] for x in row] for row in rows], np.int64)
        self.letters = [[[x for x, _ in cell[2]] for cell in row] for row in rows]
        self.state = np.array([[[q for _, q in cell[2]] for cell in row] for row in rows], np.int64)
        # Blocks: behind[j] is the vector behind symbol j of a block, for every vector behind the block.
        blocks = np.array(list(product(range(9), repeat=WIDTH)), np.int64)
        vector = np.repeat(np.arange(len(rows))[:, None], len(blocks), 1)
        behind, cost = [vector] * WIDTH, np.zeros_like(vector)
        for j in reversed(range(WIDTH)):
            behind[j] = vector
            cost = cost + self.add[vector, blocks[:, j]]
            vector = self.to[vector, blocks[:, j]]
        self.block_to, self.block_add = vector.astype(np.int16), cost.astype(np.int16)
        state = np.repeat(np.arange(4)[None, None, :], len(rows), 0).repeat(len(blocks), 1)
        for j in range(WIDTH):
            state = self.state[behind[j][:, :, None], blocks[None, :, j, None], state]
        self.block_state = state.astype(np.int8)
        self._traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def cut(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """A first part of less than ``WIDTH`` symbols, and the numbers of the blocks behind it."""
        head = len(symbols) % WIDTH
        return symbols[:head].tolist(), (symbols[head:].reshape(-1, WIDTH) @ (9 ** np.arange(WIDTH)[::-1])).tolist()

    def effect(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per vector behind the rows: vector ahead of them, cost added, and per state the state behind them."""
        head, blocks = self.cut(symbols)
        vector = np.arange(len(self.vectors))
        cost, seen = np.zeros(len(vector), np.int64), []
        for block in reversed(blocks):
            seen.append(vector)
            cost = cost + self.block_add[vector, block]
            vector = self.block_to[vector, block]
        ahead = []
        for symbol in reversed(head):
            ahead.append(vector)
            cost = cost + self.add[vector, symbol]
            vector = self.to[vector, symbol]
        state = np.repeat(np.arange(4)[None, :], len(vector), 0)
        for symbol, v in zip(head, reversed(ahead), strict=True):
            state = self.state[v[:, None], symbol, state]
        for block, v in zip(blocks, reversed(seen), strict=True):
            state = self.block_state[v[:, None], block, state]
        return vector, cost, state

    def letters_of(self, symbols: np.ndarray, vector: int, q: int) -> tuple[str, int]:
        """The edits of rows ahead of ``vector``, from state ``q``; and the state behind them."""
        head, blocks = self.cut(symbols)
        behind = []
        for block in reversed(blocks):
            behind.append(vector)
            vector = int(self.block_to[vector, block])
        out = []
        text, q = self._expand(head, vector, q)
        out.append(text)
        for block, v in zip(blocks, reversed(behind), strict=True):
            if (v, block, q) not in self._traced:
                own = [block // 9**j % 9 for j in reversed(range(WIDTH))]
                self._traced[v, block, q] = self._expand(own, v, q)
            text, q = self._traced[v, block, q]
            out.append(text)
        return "".join(out), q

    def _expand(self, symbols: list[int], vector: int, q: int) -> tuple[str, int]:
        """The vectors inside a block, from the one behind it backward, and the edits forward."""
        behind = []
        for symbol in reversed(symbols):
            behind.append(vector)
            vector = int(self.to[vector, symbol])
        text = ""
        for symbol, v in zip(symbols, reversed(behind), strict=True):
            text, q = text + self.letters[v][symbol][q], int(self.state[v, symbol, q])
        return text, q


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Symbols of codes: four times the role, plus 1 cut short, 2 blank, 3 duplicate."""
    return np.where(codes % 4 > 1, _GONE, codes // 4 * 2 + codes % 4 % 2)


def _bytes_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint8).astype(np.int64) for x in column.to_pylist()]


def _effects(pieces: DataFrame, shared) -> DataFrame:
    """Pieces with their effect and, in ``own``, what they count and their first and last role."""

    def run(batches):
        table = shared.value
        for batch in batches:
            effects, own = [], []
            for codes in _bytes_of(batch.column("codes")):
                vector, cost, state = table.effect(_symbols(codes))
                effects.append(np.concatenate([vector, cost, state.ravel()]).astype(np.int32).tobytes())
                role, fault = codes // 4, codes % 4
                legal = np.isin(role[:-1] * 4 + role[1:], [a * 4 + b for a, b in _LEGAL])
                count = [int((fault == k).sum()) for k in (2, 3, 1)]
                own.append([*count, int((~legal).sum()), int(role[0]), int(role[-1])])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("piece"), pa.array(effects, pa.binary()), pa.array(own, pa.list_(pa.int64()))],
                names=["conv", "piece", "effect", "own"],
            )

    schema = T.StructType([pieces.schema["conv"], pieces.schema["piece"]]).add("effect", T.BinaryType()).add("own", T.ArrayType(T.LongType()))
    return pieces.mapInArrow(run, schema)


def _chained(effects: DataFrame, shared) -> DataFrame:
    """Per piece the vector behind it and the state ahead of it; the first carries the conversation's figures.

    What is gathered of a conversation are its pieces' effects, about a tenth of a byte a row.
    """
    gathered = effects.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", "effect", "own"))).alias("list"))

    def run(batches):
        table = shared.value
        width = len(table.vectors)
        for batch in batches:
            for i in range(batch.num_rows):
                pieces = batch.column("list")[i].as_py()
                effect = [np.frombuffer(p["effect"], np.int32) for p in pieces]
                behind, vector, cost = [], 0, 0
                for e in reversed(effect):
                    behind.append(vector)
                    cost += int(e[width + vector])
                    vector = int(e[vector])
                behind.reverse()
                cost += table.vectors[vector][0]
                ahead, q = [], 0
                for e, v in zip(effect, behind, strict=True):
                    ahead.append(q)
                    q = int(e[2 * width + 4 * v + q])
                own = np.array([p["own"] for p in pieces])
                count = own[:, :4].sum(0)
                count[3] += sum((int(a), int(b)) not in _LEGAL for a, b in zip(own[:-1, 5], own[1:, 4], strict=True))
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv").take(pa.array([i] * n)),
                        pa.array([p["piece"] for p in pieces], pa.int64()),
                        pa.array(behind, pa.int64()),
                        pa.array(ahead, pa.int64()),
                        pa.array([k == n - 1 for k in range(n)]),
                        pa.array([[*count.tolist(), cost], *[None] * (n - 1)], pa.list_(pa.int64())),
                    ],
                    names=["conv", "piece", "behind", "ahead", "last", "figures"],
                )

    schema = T.StructType([effects.schema["conv"], effects.schema["piece"]])
    schema = schema.add("behind", T.LongType()).add("ahead", T.LongType()).add("last", T.BooleanType()).add("figures", T.ArrayType(T.LongType()))
    return gathered.mapInArrow(run, schema)


def _edits(pieces: DataFrame, shared) -> DataFrame:
    """The letters of every piece, as the text of a row that stands ahead of the piece's first."""

    def run(batches):
        table = shared.value
        for batch in batches:
            texts = []
            given = zip(_bytes_of(batch.column("codes")), *(batch.column(c).to_pylist() for c in ("behind", "ahead", "last")), strict=True)
            for codes, behind, ahead, last in given:
                text, q = table.letters_of(_symbols(codes), behind, ahead)
                texts.append(text + _LAST[q] * last)
            at = pa.array([p * PIECE for p in batch.column("piece").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), at, pa.array(texts, pa.string()), batch.column("figures")],
                names=["conv", "pos", "text", "nums"],
            )

    schema = T.StructType([pieces.schema["conv"]]).add("pos", T.LongType()).add("text", T.StringType()).add("nums", T.ArrayType(T.LongType()))
    return pieces.mapInArrow(run, schema)


class _Conversation:
    """What is known of the conversation that is being streamed."""

    def __init__(self):
        self.hash, self.empty = hashlib.sha256(), True
        self.audit, self.gaps, self.figures = [], 0, [0] * len(_FIGURES)
        self.left, self.at, self.state, self.lines = "", 0, 0, 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty, self.lines = False, self.lines + 1

    def said(self) -> str:
        return ("user", "assistant")[self.state == 2]

    def insert(self) -> None:
        while self.at < len(self.left) and self.left[self.at] == "I":
            self.line(self.said(), "")
            self.state, self.at = _TURN[self.state], self.at + 1

    def row(self, role: str, text: str) -> None:
        self.insert()
        letter, self.at = self.left[self.at], self.at + 1
        if letter == "K":
            self.line(role, text)
            self.state = _TAKES[self.state][role[0]]
        elif letter == "R":
            self.line(self.said(), text)
            self.state = _TURN[self.state]

    def edits(self, text: str, figures: list[int] | None) -> None:
        self.audit.append(text)
        self.left, self.at = text, 0
        self.figures = figures or self.figures

    def result(self) -> tuple:
        self.insert()
        return (self.gaps, *self.figures, "".join(self.audit), self.lines, self.hash.hexdigest())


_TYPES = {"audit": T.StringType(), "repaired_sha256": T.StringType()}
_RESULT = ("gaps", *_FIGURES, "audit", "repaired_rows", "repaired_sha256")


def _streamed(rows: DataFrame) -> DataFrame:
    """One row per conversation from rows in order: its own, then those of a piece's edits and their rows."""

    def run(batches):
        key, now, kind_of_key = None, None, None

        def batch_of(results):
            convs, found = zip(*results, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(convs, kind_of_key), *[pa.array(x) for x in zip(*found, strict=True)]], names=["conv", *_RESULT]
            )

        for batch in batches:
            kind_of_key, done = batch.schema.field("conv").type, []
            columns = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "nums"))
            for conv, kind, role, text, nums in zip(*columns, strict=True):
                if kind == 0:
                    if now is not None:
                        done.append((key, now.result()))
                    key, now = conv, _Conversation()
                    now.gaps = nums[0]
                elif kind == 1:
                    now.edits(text, nums)
                else:
                    now.row(role, text)
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([(key, now.result())])

    schema = T.StructType([rows.schema["conv"]])
    for name in _RESULT:
        schema = schema.add(name, _TYPES.get(name, T.LongType()))
    return rows.mapInArrow(run, schema)


def _code(role: Column, text: Column, duplicate: Column) -> Column:
    """The row's role and first fault in one number."""
    first = F.substring(role, 1, 1)
    number = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    trimmed = F.rtrim(text, F.lit(SPACE))
    fault = F.when(trimmed == "", 2).when(duplicate, 3).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    return number * 4 + fault


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: ``conv_id``, its faults, the cheapest edits and a digest of what they give.

    ``rows`` has conv_id, turn, role and text; ``conversations`` (conv_id) may name more than those,
    which get zeros and empty texts. Rows stand by turn, nulls first; of the same turn by role and text,
    so that equal rows are neighbours. A null role or text counts as one space, a null conv_id as a
    conversation. Whole texts are compared, by their sha256, and hashed. ``audit`` has a letter per edit
    and ``repaired_rows`` counts the rows left; no rows give no conversations. Other columns
    of the input play no part, whatever they are called.
    """
    given = rows.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    placed = store(ranked(given, ["conv"], ["turn", "role", "text"], "dialogue-order").drop("_total"), "dialogue-rows")
    named = placed.withColumn("digest", F.sha2("text", 256))
    alike = named.groupBy(F.col("conv").alias("of"), F.col("role").alias("as"), F.col("digest").alias("like"))
    first = alike.agg(F.min("_pos").alias("first"))
    same = F.col("conv").eqNullSafe(F.col("of")) & (F.col("role") == F.col("as")) & (F.col("digest") == F.col("like"))
    coded = named.select(
        "conv", "role", "digest", "_pos", _code(F.col("role"), F.col("text"), F.lit(False)).alias("alone")
    ).join(first, same)
    # A blank row stays blank, whatever it repeats.
    again = (F.col("_pos") > F.col("first")) & (F.col("alone") % 4 != 2)
    code = F.when(again, F.floor(F.col("alone") / 4) * 4 + 3).otherwise(F.col("alone")).cast("int")
    piece = F.floor(F.col("_pos") / PIECE).alias("piece")
    listed = F.sort_array(F.collect_list(F.struct("_pos", code.alias("code"))))
    text = F.array_join(F.transform(listed, lambda x: F.lpad(F.hex(x["code"]), 2, "0")), "")
    pieces = store(
        coded.groupBy("conv", piece).agg(F.unhex(text).alias("codes")), "dialogue-pieces"
    )
    shared = rows.sparkSession.sparkContext.broadcast(Tables())
    plan = store(_chained(_effects(pieces, shared), shared), "dialogue-plan")
    plan = plan.withColumnsRenamed({"conv": "of", "piece": "nr"})
    met = pieces.join(plan, F.col("conv").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("nr"))).drop("of", "nr")
    days = given.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    span = days.groupBy(F.col("conv").alias("of")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("bigint").alias("gaps")
    )
    every = given.select("conv")
    if conversations is not None:
        every = every.unionByName(conversations.select(F.col("conv_id").alias("conv")))
    every = every.distinct().join(span, F.col("conv").eqNullSafe(F.col("of")), "left")
    none = F.lit(None).cast("string")
    stream = (
        every.select(
            "conv", F.lit(-1).cast("bigint").alias("pos"), F.lit(0).alias("kind"), none.alias("role"), none.alias("text"),
            F.array(F.coalesce("gaps", F.lit(0).cast("bigint"))).alias("nums"),
        )
        .unionByName(_edits(met, shared).select("conv", "pos", F.lit(1).alias("kind"), none.alias("role"), "text", "nums"))
        .unionByName(
            placed.select(
                "conv", F.col("_pos").alias("pos"), F.lit(2).alias("kind"), "role", "text",
                F.lit(None).cast("array<bigint>").alias("nums"),
            )
        )
    )
    ordered = stream.repartition("conv").sortWithinPartitions("conv", "pos", "kind")
    return _streamed(ordered).withColumnRenamed("conv", "conv_id")
