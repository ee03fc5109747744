"""Exact order statistics from counts of values, without lists of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def frequencies(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, n): how often each value occurs in its group; nulls are left out.

    Added up per task before anything moves, however many rows a group has.
    """
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def _place(count: Column, share: tuple[int, int]) -> Column:
    """Place from zero of the share's element among ``count``: whole numbers, the last one at most."""
    part, whole = share
    product = count * part
    return F.least((product - F.pmod(product, F.lit(whole))) / whole, count - 1)


def order_statistics(
    counts: DataFrame, by: Sequence[str], value: str, shares: dict[str, tuple[int, int]], n: str = "n"
) -> DataFrame:
    """One row per group: ``n_values`` and, for each of ``shares``, the value at that share of the order.

    A share (1, 2) is the upper median: of an even number the element after the middle; (0, 1) is the
    least and (1, 1) the greatest. ``counts`` has one row per group and distinct value, which is what is
    sorted: a value is the one at a place just if fewer rows are below it and more are up to it.
    """
    for name, (part, whole) in shares.items():
        if not 0 <= part <= whole or whole < 1:
            raise ValueError(f"{name}: no share of a whole")
    group = Window.partitionBy(*by)
    upto = F.sum(n).over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"_upto": upto, "_all": F.sum(n).over(group)})
    count = F.col("_all")

    def at(share: tuple[int, int]) -> Column:
        place = _place(count, share)
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col(n) <= place), F.col(value)))

    return ranked.groupBy(*by).agg(F.max("_all").alias("n_values"), *[at(s).alias(name) for name, s in shares.items()])
