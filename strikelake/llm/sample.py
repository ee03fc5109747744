"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(ident: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % divisor


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, *, rows: int, max_bytes: int, by_class: bool, ident: str = "doc_id"
) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs, in the order of a hash of the id.

    With ``by_class`` at most half of them are of either label. Rows without an id, a 0/1 label or a
    text are not used; nor are, for the fit alone, texts of more than ``max_bytes``, so that
    rows times max_bytes bounds what the driver holds. The ids are chosen from the labels alone and
    broadcast, as their number is bounded.
    """
    known = labels.select(ident, F.col(label).cast("int").alias("_label")).filter(
        F.col(ident).isNotNull() & F.col("_label").isin(0, 1)
    )
    order = F.xxhash64(ident)
    each = rows // 2 if by_class else rows
    groups = [known.filter(F.col("_label") == v) for v in (0, 1)] if by_class else [known]
    chosen = [g.orderBy(order, ident).limit(each) for g in groups]
    picked = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    picked = picked.groupBy(ident).agg(F.max("_label").alias("_label"))
    texts = docs.select(ident, "text").filter(F.octet_length("text").between(1, max_bytes))
    # An id may have several documents; the limit holds for those too.
    found = texts.join(F.broadcast(picked), ident).select("text", "_label", ident).orderBy(order, ident, "text").limit(rows)
    return [(r[0], r[1]) for r in found.select("text", "_label").collect()]
