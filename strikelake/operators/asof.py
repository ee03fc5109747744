"""Forward as-of lookup on day tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def next_dates(candidates: DataFrame, calendar: DataFrame, lookups: dict[str, str]) -> DataFrame:
    """First calendar date at or after a candidate date of the same symbol, null if none.

    ``lookups`` maps candidate columns to the names of the results; all of them are answered by
    one pass over the calendar. ``candidates`` has one row per symbol and ``calendar`` one per
    symbol and date, so the join meets every date once and is reduced to a minimum right away. The
    candidates' own columns ride along as grouping columns: what they were made from is read once.
    """
    met = candidates.join(calendar.select("symbol", F.col("date").alias("_date")), "symbol", "left")
    return met.groupBy(*candidates.columns).agg(
        *[
            F.min(F.when(F.col("_date") >= F.col(since), F.col("_date"))).alias(found)
            for since, found in lookups.items()
        ]
    )


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def next_date(candidates: DataFrame, calendar: DataFrame, since: str, found: str) -> DataFrame:
    """Every candidate with ``found``, the first calendar date of its symbol at or after its ``since``.

    For any number of candidates per symbol: they are sorted among the calendar's dates once, by symbol
    and month, so that a symbol with most of the rows is many groups, and no candidate meets more than
    one date. Walking a month backward, the last date passed is the next one; what a month's last
    candidates need is the first date of a later month, carried by one row per symbol and month.
    ``calendar`` has (symbol, date), repeats and nulls do no harm. Null where no date follows, or for a
    candidate without a date or symbol. All columns of the candidates stay; repeated rows too.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in candidates.columns])
    kept = candidates.select("symbol", F.col(since).alias("_day"), row.alias("_row"), F.lit(None).cast("date").alias("_date"))
    known = calendar.filter(F.col("symbol").isNotNull() & F.col("date").isNotNull()).select("symbol", "date").distinct()
    dates = known.select("symbol", F.col("date").alias("_day"), F.lit(None).cast(kept.schema["_row"].dataType).alias("_row"), F.col("date").alias("_date"))
    # Of one day the calendar's date comes first on the way back.
    events = kept.unionByName(dates).withColumn("_month", _month(F.col("_day")))
    back = Window.partitionBy("symbol", "_month").orderBy(F.desc("_day"), F.desc_nulls_last("_date"))
    inside = F.last("_date", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = events.withColumn("_in", inside).filter(F.col("_row").isNotNull())
    later = Window.partitionBy("symbol").orderBy("_month").rowsBetween(1, Window.unboundedFollowing)
    carried = (
        events.filter("symbol IS NOT NULL AND _month IS NOT NULL")
        .groupBy("symbol", "_month")
        .agg(F.min("_date").alias("_first"))
        .withColumn("_next", F.min("_first").over(later))
        .select("symbol", "_month", "_next")
    )
    return met.join(carried, ["symbol", "_month"], "left").select("_row.*", F.coalesce("_in", "_next").alias(found))
