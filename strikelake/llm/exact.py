"""Exact dedup by distributed MSD radix partitioning.

Texts are split by successive bytes: first by their length (equal texts have equal lengths) and first
bytes, then each group by its next bytes, until a group has one text left or its texts have ended. The
piece grows sixteenfold a round, so that a text of n bytes is settled after log16(n) rounds. Bytes are
compared themselves; nothing rests on a digest. A round is an aggregation, which sends one row per group
and task however many copies there are, and a join back that adaptive execution splits where a group
is hot. Only texts that still share all bytes so far go on to the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strikelake.llm.shared import passing, store, text_or_empty

FIRST, GROWTH = 64, 16
# Replaces each run of white space by one space, touching only runs that are not one space already.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text"):
    """Each run of space and \\t \\n \\v \\f \\r as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), _RUN, " ")


def _split(docs: DataFrame, text: str, *columns) -> DataFrame:
    """The rows, written once, with a number, ``_size`` and, where length and first bytes are shared, ``_group``.

    Those rows alone carry their text on as ``_body``.
    """
    size = F.octet_length(normalised(text))
    cut = F.substring(normalised(text).cast("binary"), 1, FIRST)
    body = normalised(text).cast("binary")
    whole = docs.select(*columns, body.alias("_body"))
    whole = whole.withColumns({"_size": F.octet_length("_body"), "_cut": F.substring("_body", 1, FIRST)})
    with passing(docs.sparkSession):
        heads = docs.select(size.alias("_size"), cut.alias("_cut")).groupBy("_size", "_cut").agg(F.count("*").alias("_n"))
        heads = store(heads.filter("_n > 1").select("_size", "_cut", F.monotonically_increasing_id().alias("_group")), "radix-heads")
        # As many shared heads as copies: they are merged, at any size, not broadcast.
        met = whole.join(heads.hint("merge"), ["_size", "_cut"], "left").drop("_cut")
        named = met.withColumn("_body", F.when(F.col("_group").isNotNull(), F.col("_body")))
        return store(named.withColumn("_row", F.monotonically_increasing_id()), "radix-rows", lasting=True)


def _groups(rows: DataFrame) -> DataFrame:
    """(row, first row, first id, size) of every row whose text occurs more than once."""
    rows = rows.filter(F.col("_group").isNotNull())
    going, at, width, turn = rows, FIRST, FIRST * GROWTH, 0
    members = None
    while True:
        ended = going.filter(F.col("_size") <= at).select("_row", F.lit(turn).alias("_turn"), "_group")
        members = ended if members is None else members.unionByName(ended)
        going = going.filter(F.col("_size") > at)
        if going.isEmpty():
            break
        cut = going.select("_row", "_group", "_size", "_body", F.substring("_body", at + 1, width).alias("_cut"))
        split = cut.groupBy("_group", "_cut").agg(F.count("*").alias("_n"), F.min("_row").alias("_next"))
        split = store(split.filter("_n > 1").drop("_n"), "radix-split")
        at, width, turn = at + width, width * GROWTH, turn + 1
        rest = F.when(F.col("_size") > at, F.col("_body")).alias("_body")
        left = cut.join(split, ["_group", "_cut"]).select("_row", F.col("_next").alias("_group"), "_size", rest)
        going = store(left, "radix-alive")
    named = members.join(rows.select("_row", "_id"), "_row")
    named = store(named, "radix-members")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    figures = named.groupBy("_turn", "_group").agg(F.count("*").alias("_copies"), first.alias("_first"))
    figures = store(figures.filter("_copies > 1"), "radix-groups")
    return named.join(figures, ["_turn", "_group"]).select("_row", "_first", "_copies")


def mark_copies(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of the normalised text.

    Null counts as empty text, and empty texts are copies of one another. Of equal texts the row with
    the smallest id stays; a row without an id comes after those with one, and of several with the
    same id just one stays. Whole texts of any length are compared. No rows give no rows.
    """
    digest = F.sha2(normalised(text), 256).alias("text_sha256")
    rows = _split(docs, text, F.col(ident).alias("_id"), digest)
    single = rows.filter(F.col("_group").isNull()).select(
        F.col("_id").alias(ident), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    shared = rows.filter(F.col("_group").isNotNull()).select("_row", F.col("_id").alias(ident), "text_sha256")
    return single.unionByName(
        shared.join(_groups(rows), "_row", "left").select(
            ident,
            F.when(F.col("_copies").isNull(), F.col(ident)).otherwise(F.col("_first.id")).alias("keep_id"),
            F.coalesce("_copies", F.lit(1)).cast("bigint").alias("group_size"),
            F.coalesce(F.col("_first.row") == F.col("_row"), F.lit(True)).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that ``mark_copies`` keeps, with all their columns, whatever those are called."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_record")
    rows = _split(docs, text, record, F.col(ident).alias("_id"))
    with passing(docs.sparkSession):
        dropped = _groups(rows).filter(F.col("_first.row") != F.col("_row")).select("_row")
        dropped = store(dropped, "radix-dropped", lasting=True)
    single = rows.filter(F.col("_group").isNull()).select("_record")
    shared = rows.filter(F.col("_group").isNotNull()).join(dropped, "_row", "left_anti").select("_record")
    return single.unionByName(shared).select("_record.*")
