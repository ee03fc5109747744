"""One row per symbol and day: the small table that every check can be computed from.

A day profile is made by one partial aggregation over the raw rows; its size is bounded by
symbols x calendar days however many rows a symbol has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strikelake.functions import is_call, percent, upper_median
from strikelake.operators.facts import (
    delta_outlier_counts,
    has_type,
    nonpositive_counts,
    null_counts,
    zero_counts,
)
from strikelake.operators.ranks import frequencies, order_statistics
from strikelake.schemas import OPTION_REQUIRED, PRICE_REQUIRED

# A side is covered when |delta| reaches from 0.2 to 0.8; share of days to pass.
WING, NEAR_THE_MONEY, COVERAGE_SHARE = 0.2, 0.8, 80.0


def coverage_inputs(df: DataFrame) -> str | None:
    """Why coverage cannot be judged on these columns, or None."""
    for column, kind in (
        ("quote_date", T.DateType),
        ("delta", T.DoubleType),
        ("option_type", T.StringType),
    ):
        if not has_type(df, column, kind):
            return f"no usable {column} column"
    return None


def _coverage_aggregates() -> list[Column]:
    """Rows with date, delta and type, and whether both sides are covered on the day.

    Both sides are conditional aggregates of one group, so a day is one row and needs no second
    grouping by side. A NaN delta counts as a row but not in the extremes.
    """
    delta, kind = F.col("delta"), F.col("option_type")
    complete = F.col("quote_date").isNotNull() & delta.isNotNull() & kind.isNotNull()

    def covered(on_side: Column) -> Column:
        size = F.when(complete & on_side & ~F.isnan(delta), F.abs(delta))
        return (F.min(size) <= WING) & (F.max(size) >= NEAR_THE_MONEY)

    both = covered(is_call(kind)) & covered(~is_call(kind))
    return [
        F.count_if(complete).alias("coverage_rows"),
        F.coalesce(both, F.lit(False)).alias("covered"),
    ]


def _option_counts(df: DataFrame) -> list[Column]:
    return [
        F.count("*").alias("n_rows"),
        *null_counts(df, OPTION_REQUIRED),
        *zero_counts(df),
        *delta_outlier_counts(df),
    ]


def _price_counts(df: DataFrame) -> list[Column]:
    return [F.count("*").alias("n_rows"), *null_counts(df, PRICE_REQUIRED), *nonpositive_counts(df)]


def options_totals(df: DataFrame) -> DataFrame:
    """Rows, nulls, zeros and outliers of each symbol: the sums of :func:`options_daily`."""
    return df.groupBy(F.col("underlying_symbol").alias("symbol")).agg(*_option_counts(df))


def prices_totals(df: DataFrame) -> DataFrame:
    """Rows, nulls and non-positive levels of each symbol: the sums of :func:`prices_daily`."""
    return df.groupBy("symbol").agg(*_price_counts(df))


def options_daily(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Rows, nulls, zeros, outliers and coverage of each symbol and quote date.

    ``also`` names columns that are one for all rows of a symbol and day and are kept.
    """
    usable = has_type(df, "quote_date", T.DateType)
    day = F.col("quote_date") if usable else F.lit(None).cast("date")
    coverage = _coverage_aggregates() if coverage_inputs(df) is None else []
    return df.groupBy(F.col("underlying_symbol").alias("symbol"), day.alias("day"), *also).agg(
        *_option_counts(df), *coverage
    )


def prices_daily(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Rows, nulls and non-positive levels of each symbol and price date, with the columns ``also``."""
    usable = has_type(df, "date", T.DateType)
    day = F.col("date") if usable else F.lit(None).cast("date")
    return df.groupBy("symbol", day.alias("day"), *also).agg(*_price_counts(df))


def coverage_figures() -> list[Column]:
    """Roll-up of day rows by symbol: days, covered days, upper median of rows per day."""
    counted = F.col("coverage_rows") > 0
    return [
        F.count_if(counted).alias("total_dates"),
        F.count_if(counted & F.col("covered")).alias("passing_dates"),
        upper_median(F.collect_list(F.when(counted, F.col("coverage_rows")))).alias("median_strikes"),
    ]


def delta_coverage(df: DataFrame) -> DataFrame:
    """Share of days on which calls and puts both reach from the money to the wings.

    Two levels of aggregation: day figures, then one roll-up by symbol whose groups are days.
    """
    problem = coverage_inputs(df)
    if problem:
        raise ValueError(problem)
    days = df.groupBy(F.col("underlying_symbol").alias("symbol"), F.col("quote_date").alias("day")).agg(
        *_coverage_aggregates()
    )
    out = days.groupBy("symbol").agg(*coverage_figures())
    pct = percent(F.col("passing_dates"), F.col("total_dates"))
    return out.withColumn("coverage_pct", pct).withColumn(
        "status", F.when(F.col("coverage_pct") >= COVERAGE_SHARE, "PASS").otherwise("WARN")
    )


def strikes_per_quantile(df: DataFrame, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """Complete rows per day of each symbol: number of days, and the counts at shares of their order.

    Days become counts of counts, which are few, so that no symbol's days are ever gathered.
    """
    complete = df.dropna(subset=["quote_date", "delta", "option_type"])
    days = complete.groupBy(F.col("underlying_symbol").alias("symbol"), "quote_date").agg(
        F.count("*").alias("rows_of_day")
    )
    found = order_statistics(frequencies(days, ["symbol"], "rows_of_day"), ["symbol"], "rows_of_day", shares)
    return found.withColumnRenamed("n_values", "total_dates")


def strikes_per_day(df: DataFrame) -> DataFrame:
    """Upper median of the complete rows per day; ``1`` and ``3`` give 3, not 2."""
    complete = df.dropna(subset=["quote_date", "delta", "option_type"])
    days = complete.groupBy(F.col("underlying_symbol").alias("symbol"), "quote_date").agg(
        F.count("*").alias("rows_of_day")
    )
    return days.groupBy("symbol").agg(
        F.count("*").alias("total_dates"),
        upper_median(F.collect_list("rows_of_day")).alias("median_strikes"),
    )
