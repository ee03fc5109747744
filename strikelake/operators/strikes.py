"""Price-informed strike bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The band as multiples of the close.
BAND_LOW, BAND_HIGH = 0.35, 2.65


def band_edges(close: Column) -> tuple[Column, Column, Column]:
    """Low, middle and high strike of the band around a close."""
    low, high = close * BAND_LOW, close * BAND_HIGH
    return low, (low + high) / 2, high


def close_by_day(prices: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """One close per symbol and date: the first complete row in ``order_by``, else the lowest."""
    complete = prices.filter(F.col("date").isNotNull() & F.col("close").isNotNull())
    first = F.min_by("close", F.struct(*order_by)) if order_by else F.min("close")
    return complete.groupBy("symbol", "date").agg(first.alias("close"))


def strike_band(options: DataFrame, prices: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Marks each quote ``lower``, ``upper`` or ``outside`` of its day's band; null without a price.

    Strikes just above the middle belong to the upper half, none are lost between the halves.
    The price side is one row per symbol and day. Spark broadcasts it while it is small by its own
    measure; beyond that it sort-merges and splits a day that holds much of the data.
    """
    closes = close_by_day(prices, order_by).select(
        F.col("symbol").alias("underlying_symbol"), F.col("date").alias("quote_date"), "close"
    )
    low, mid, high = band_edges(F.col("close"))
    strike = F.col("strike")
    band = (
        F.when(F.col("close").isNull(), None)
        .when(strike.between(low, mid), "lower")
        .when((strike > mid) & (strike <= high), "upper")
        .otherwise("outside")
    )
    return options.join(closes, ["underlying_symbol", "quote_date"], "left").withColumn("band", band)
