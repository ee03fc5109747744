"""Calendars: stored dates, weekdays, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.functions import is_weekday, weekday_from_ordinal, weekday_ordinal

# A run of more missing weekdays than this is reported; dates listed at most.
LONG_GAP, LISTED_DATES = 3, 5


def trading_calendar(df: DataFrame, symbol: str, column: str) -> DataFrame:
    """Distinct non-null dates per symbol."""
    return (
        df.filter(F.col(column).isNotNull())
        .select(F.col(symbol).alias("symbol"), F.col(column).alias("date"))
        .distinct()
    )


def date_range(df: DataFrame, column: str, date_from: str | None, date_to: str | None) -> DataFrame:
    """Rows with ``date_from`` <= column <= ``date_to``, both inclusive.

    Written as a half-open range, so it holds for dates and timestamps alike and is compared
    without casting the column: the range reaches the scan.
    """
    if date_from is not None:
        df = df.filter(F.col(column) >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.filter(F.col(column) < F.date_add(F.lit(date_to).cast("date"), 1))
    return df


def weekday_calendar(df: DataFrame, symbol: str, column: str) -> DataFrame:
    """Every Monday to Friday from the first to the last date of each symbol."""
    spans = df.groupBy(F.col(symbol).alias("symbol")).agg(
        F.min(column).alias("first"), F.max(column).alias("last")
    )
    days = spans.filter(F.col("first").isNotNull()).select(
        "symbol", F.explode(F.sequence("first", "last")).alias("date")
    )
    return days.filter(is_weekday(F.col("date")))


def gap_anchor(day: Column, first: Column, last: Column) -> Column:
    """Weekday number that a stored date ends a gap with, null for a date that ends none.

    A stored weekday ends the gap before it. A weekend date does not, unless it bounds the
    calendar: as the first date it stands for its Friday, as the last for the Monday after.
    """
    return (
        F.when(is_weekday(day) | (day == first), weekday_ordinal(day))
        .when(day == last, weekday_ordinal(day) + 1)
    )


def weekday_gaps(df: DataFrame, symbol: str = "symbol", column: str = "date") -> DataFrame:
    """Runs of missing weekdays between first and last date: first day, last day, length.

    Friday and the Monday after are neighbours. Instead of writing out the calendar and taking
    the stored dates away, each stored date is compared with the one before, so the cost follows
    the dates that exist. A window's group holds one symbol's distinct dates.
    """
    days = trading_calendar(df, symbol, column)
    bounds = Window.partitionBy("symbol").orderBy("date")
    last = F.when(F.lead("date").over(bounds).isNull(), F.col("date"))
    first = F.when(F.lag("date").over(bounds).isNull(), F.col("date"))
    anchors = days.withColumns({"_first": first, "_last": last}).select(
        "symbol",
        "date",
        gap_anchor(F.col("date"), F.col("_first"), F.col("_last")).alias("_anchor"),
    )
    anchors = anchors.filter(F.col("_anchor").isNotNull()).withColumn(
        "_before", F.lag("_anchor").over(bounds)
    )
    return anchors.filter(F.col("_anchor") - F.col("_before") > 1).select(
        "symbol",
        weekday_from_ordinal(F.col("_before") + 1).alias("gap_start"),
        weekday_from_ordinal(F.col("_anchor") - 1).alias("gap_end"),
        (F.col("_anchor") - F.col("_before") - 1).cast("bigint").alias("missing_days"),
    )


def prices_gaps(df: DataFrame) -> DataFrame:
    """Gaps of more than three weekdays in the price dates."""
    return weekday_gaps(df).filter(F.col("missing_days") > LONG_GAP)


def missing_weekdays(df: DataFrame, symbol: str = "symbol", column: str = "date") -> DataFrame:
    """The missing weekdays themselves; only the gaps are written out."""
    days = weekday_gaps(df, symbol, column).select(
        "symbol", F.explode(F.sequence("gap_start", "gap_end")).alias("date")
    )
    return days.filter(is_weekday(F.col("date")))


def options_gaps(options: DataFrame, prices: DataFrame) -> DataFrame:
    """Price dates in the common range that have no option quotes, per options symbol.

    ``outcome`` is ``no_prices``, ``no_dates``, ``no_overlap``, ``gaps`` or ``ok``. Both sides
    become flags of one (symbol, date) row, so membership needs no join; the second step groups a
    symbol's dates. Dates are listed when there are at most five.
    """
    tagged = options.select(
        F.col("underlying_symbol").alias("symbol"),
        F.col("quote_date").alias("date"),
        F.lit(True).alias("quoted"),
        F.lit(False).alias("priced"),
    ).unionByName(
        prices.select("symbol", "date", F.lit(False).alias("quoted"), F.lit(True).alias("priced"))
    )
    days = tagged.groupBy("symbol", "date").agg(
        F.max("quoted").alias("quoted"), F.max("priced").alias("priced")
    )
    return gap_figures(days, F.col("quoted"), F.col("priced"), F.col("date"))


def overlap_columns(quoted: Column, priced: Column, day: Column) -> dict[str, Column]:
    """Per day row of a symbol: whether it is a price day in the common range, and missing."""
    of_symbol = Window.partitionBy("symbol")
    quoted_day, priced_day = F.when(quoted, day), F.when(priced, day)
    # greatest and least skip nulls, so a side without dates is tested for by itself.
    both = F.min(quoted_day).over(of_symbol).isNotNull() & F.min(priced_day).over(of_symbol).isNotNull()
    start = F.greatest(F.min(quoted_day).over(of_symbol), F.min(priced_day).over(of_symbol))
    end = F.least(F.max(quoted_day).over(of_symbol), F.max(priced_day).over(of_symbol))
    inside = F.coalesce(priced & both & day.between(start, end), F.lit(False))
    return {
        "_trading_day": inside,
        "_missing_day": inside & ~quoted,
        "_overlap": F.coalesce(both & (start <= end), F.lit(False)),
        "_dated": both,
    }


def gap_aggregates(quoted: Column, priced: Column, day: Column) -> list[Column]:
    """Roll-up of :func:`overlap_columns` by symbol."""
    missing = F.col("_missing_day")
    return [
        F.max(quoted).alias("has_options"),
        F.max(priced).alias("has_prices"),
        F.max("_dated").alias("has_dates"),
        F.max("_overlap").alias("has_overlap"),
        F.count_if("_trading_day").alias("trading_days"),
        F.count_if(missing).alias("missing_days"),
        F.array_join(
            F.slice(F.sort_array(F.collect_list(F.when(missing, day.cast("string")))), 1, LISTED_DATES + 1),
            ", ",
        ).alias("_first_missing"),
    ]


def gap_outcome() -> Column:
    return (
        F.when(~F.col("has_prices"), "no_prices")
        .when(~F.col("has_dates"), "no_dates")
        .when(~F.col("has_overlap"), "no_overlap")
        .when(F.col("missing_days") > 0, "gaps")
        .otherwise("ok")
    )


def listed_dates() -> Column:
    return F.when(F.col("missing_days").between(1, LISTED_DATES), F.col("_first_missing"))


def gap_figures(days: DataFrame, quoted: Column, priced: Column, day: Column) -> DataFrame:
    figures = (
        days.withColumns(overlap_columns(quoted, priced, day))
        .groupBy("symbol")
        .agg(*gap_aggregates(quoted, priced, day))
        .filter(F.col("has_options"))
    )
    return figures.select(
        "symbol",
        gap_outcome().alias("outcome"),
        "trading_days",
        "missing_days",
        listed_dates().alias("missing_dates"),
    )
