"""A Merkle manifest of a table, with proofs by checkpoint and recompute.

Rows are leaves, in order, of one tree per group; the groups' roots are the leaves of a last tree, whose
root stands for the whole table. Only every third level of a tree is stored. A block of 8^3 = 512 nodes
of a stored level is the aligned subtree below one node of the next: to extract proofs its missing
levels are hashed again from the stored block, each member gets its siblings in them followed by what
the node above has, and the recomputed levels are dropped. A block is all that a task holds, whatever
the group's size, and what lies above is carried once per block. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.llm.shared import ranked, store

ARITY, STRIDE = 8, 3
BLOCK = ARITY**STRIDE
NODES_A_FILE = 1 << 18
_POWERS = [ARITY**i for i in range(21)]


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of texts, one after the other."""
    return F.sha2(F.concat(*values), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of a row: each value as its count of UTF-8 bytes, a colon and itself; null as a dash."""
    texts = [v.cast("string") for v in values]
    sized = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return digest(*[F.coalesce(s, F.lit("-")) for s in sized])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and a path of siblings lead to."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All sibling digests of a path, bottom up and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _above(level: Column) -> Column:
    """Digests of every run of ``ARITY`` nodes, the last run being what is left."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(level, r * ARITY + 1, ARITY), ""), 256))


def _step(level: Column, index: Column) -> Column:
    """Siblings before and after the node at ``index`` within its run."""
    own = index % ARITY
    before = F.slice(level, index - own + 1, own)
    after = F.slice(level, index + 2, F.lit(ARITY - 1) - own)
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


@dataclass(frozen=True)
class Tree:
    """Stored levels of the trees of all groups: ``g``, ``height``, ``pos``, ``hash``; leaves have ``record``."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(g, height, hash): each group's root, a lone leaf's own digest included."""
        found = None
        for i, nodes in enumerate(self.levels):
            ended = F.col("height") <= STRIDE * i
            ended &= F.col("height") > STRIDE * (i - 1)
            mine = nodes.filter(ended).select("g", "height", "hash")
            found = mine if found is None else found.unionByName(mine)
        return found


def _blocks(nodes: DataFrame, low: int, *members: str) -> DataFrame:
    """Aligned subtrees over the nodes of level ``low`` of trees that go on above it."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "hash", *members)))
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    return nodes.filter(F.col("height") > low).groupBy("g", "height", block).agg(listed.alias("m"))


def _regrown(blocks: DataFrame, low: int) -> DataFrame:
    """Blocks with their digests at ``low`` (l0) and the levels above as far as the tree goes (l1, ..)."""
    out = blocks.withColumn("l0", F.transform("m", lambda x: x["hash"]))
    for k in range(1, STRIDE + 1):
        grown = F.when(F.col("height") >= low + k, _above(F.col(f"l{k - 1}")))
        out = out.withColumn(f"l{k}", grown.otherwise(F.col(f"l{k - 1}")))
    return out


def _grow(rows: DataFrame, order: list[str], group: list[str], label: str) -> Tree:
    """``rows`` has (g, hash, record) and the order columns; one tree per g."""
    placed = ranked(rows, group, order, f"{label}-order")
    powers = F.array(*[F.lit(p).cast("bigint") for p in _POWERS])
    height = F.size(F.filter(powers, lambda p: p < F.col("_total")))
    # The sorted leaves are what is stored; their places follow from a small table at each reading.
    levels = [placed.select("g", height.alias("height"), F.col("_pos").alias("pos"), "hash", "record")]
    top, nodes = levels[0].agg(F.max("height"), F.count("*")).first()
    for low in range(0, top or 0, STRIDE):
        grown = _regrown(_blocks(levels[-1], low), low)
        node = grown.select("g", "height", F.col("block").alias("pos"), F.element_at(f"l{STRIDE}", 1).alias("hash"))
        # A level has about a 512th of the rows below, and files in proportion.
        nodes = nodes // BLOCK
        levels.append(store(node.repartition(1 + nodes // NODES_A_FILE), f"{label}-level{low + STRIDE}"))
    return Tree(levels)


def _paths(tree: Tree, tops: DataFrame) -> DataFrame:
    """Every leaf's ``record``, ``hash``, ``path`` and the ``crown`` of its group.

    ``tops`` has (g, path, crown) of each group's root: what lies above it and what is known of it.
    """
    lone = F.lit(0).cast("bigint").alias("at")
    done = tops.withColumnRenamed("g", "of")
    upper = None
    for i in reversed(range(len(tree.levels))):
        low, nodes = STRIDE * i, tree.levels[i]
        members = ["record"] if i == 0 else []
        ended = tops.select(F.col("g").alias("of"), "height", lone, "path", "crown")
        ended = ended.filter((F.col("height") > low) & (F.col("height") <= low + STRIDE)).drop("height")
        parents = ended if upper is None else ended.unionByName(upper)
        blocks = _regrown(_blocks(nodes, low, *members), low)
        met = blocks.join(parents, F.col("g").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))

        def path(index: Column, low: int = low) -> Column:
            own = [
                F.when(F.col("height") > low + k, F.array(_step(F.col(f"l{k}"), F.floor(index / ARITY**k).cast("int"))))
                for k in range(STRIDE)
            ]
            none = F.filter("path", lambda s: F.lit(False))
            return F.concat(*[F.coalesce(x, none) for x in own], F.col("path"))

        each = F.transform(
            "m",
            lambda x, j: F.struct(
                x["pos"].alias("at"), x["hash"].alias("hash"), *[x[c].alias(c) for c in members], path(j).alias("path")
            ),
        )
        upper = met.select(F.col("g").alias("of"), "crown", F.explode(each).alias("e")).select("of", "e.*", "crown")
        if i:
            upper = upper.drop("hash")
    alone = tree.levels[0].filter("height = 0").join(done, F.col("g").eqNullSafe(F.col("of")))
    return upper.select("record", "hash", "path", "crown").unionByName(alone.select("record", "hash", "path", "crown"))


def prove(
    docs: DataFrame, columns: list[str], *, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None
) -> DataFrame:
    """Every row's proof: ``leaf``, ``path``, ``subroot``, ``root`` and the columns that ``carry`` computes.

    ``columns`` are what a leaf's digest covers, in this order. Leaves stand by ``order``, nulls first,
    then by digest, so repeated rows have a place of their own each and proofs that hold; a null
    group is a group, the first. ``path`` has per level the siblings ``before`` and ``after`` the node,
    both empty where it is alone in its run. Whole texts are hashed. An empty table has no
    rows and no root. Other columns of the input, whatever they are called, play no part.
    """
    record = F.struct(*[c.alias(n) for n, c in (carry or {}).items()]) if carry else F.struct(F.lit(0).alias("_none"))
    rows = docs.select(
        F.col(f"`{group}`").alias("g"),
        F.col(f"`{order}`").alias("o"),
        leaf([F.col(f"`{c}`") for c in columns]).alias("hash"),
        record.alias("record"),
    )
    trees = _grow(rows, ["o", "hash"], ["g"], "merkle")
    tops = store(trees.tops(), "merkle-tops")
    crowns = tops.select(F.lit(0).alias("g"), "hash", F.struct("g", "height").alias("record"), F.col("g").alias("o"))
    last = _grow(crowns, ["o"], ["g"], "merkle-crown")
    no_path = F.expr("filter(array(named_struct('before', '', 'after', '')), s -> false)")
    peak = last.tops().select("g", "height", no_path.alias("path"), F.col("hash").alias("crown"))
    above = _paths(last, peak).select(
        F.col("record.g").alias("g"),
        F.col("record.height").alias("height"),
        "path",
        F.struct(F.col("hash").alias("subroot"), F.col("crown").alias("root")).alias("crown"),
    )
    found = _paths(trees, store(above, "merkle-above"))
    return found.select(
        *[F.col("record").getField(n).alias(n) for n in (carry or {})],
        F.col("hash").alias("leaf"),
        "crown.subroot",
        "crown.root",
        "path",
    )
