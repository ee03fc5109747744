"""Raw daily quotes (epoch seconds and OHLCV) to the prices table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.schemas import PRICE_LEVELS

# First and last second of the years 0001 to 9999, the range of a date.
FIRST_SECOND = -62135596800
LAST_SECOND = 253402300799


def _valid() -> Column:
    ts = F.col("timestamp")
    return ts.between(FIRST_SECOND, LAST_SECOND)


def prices_from_quotes(quotes: DataFrame) -> DataFrame:
    """One price bar per quote with a possible timestamp, date first; the others are dropped.

    The day is computed from the seconds themselves, so it is the UTC day in any session zone
    and no timestamp can overflow.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("timestamp") / 86400).cast("int"))
    extra = [c for c in quotes.columns if c not in ("symbol", "timestamp", "volume", *PRICE_LEVELS)]
    return quotes.filter(_valid()).select(
        "symbol",
        day.alias("date"),
        *[F.col(c).cast("double").alias(c) for c in PRICE_LEVELS],
        F.col("volume").cast("bigint").alias("volume"),
        *extra,
    )


def quote_errors(quotes: DataFrame) -> DataFrame:
    """Per symbol: quotes, usable quotes and the error when not one of them is usable."""
    counts = quotes.groupBy("symbol").agg(
        F.count("*").alias("n_quotes"), F.count_if(_valid()).alias("n_valid")
    )
    return counts.withColumn(
        "error",
        F.when(
            F.col("n_valid") == 0,
            F.concat(F.lit("no quote of "), "symbol", F.lit(" has a usable time")),
        ),
    )
