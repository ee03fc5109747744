"""What to load next, from what is stored."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.functions import side
from strikelake.operators.asof import next_dates
from strikelake.operators.calendar import trading_calendar

SIDES = ("call", "put")


def _both_sides(per_symbol: DataFrame) -> DataFrame:
    """One row per symbol with a column per side to one row per symbol and side."""
    return per_symbol.select(
        "symbol",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("option_type"),
                        F.col(f"{s}_last").alias("last_date"),
                        F.col(f"{s}_next").alias("next_trading_day"),
                    )
                    for s in SIDES
                ]
            )
        ).alias("_s"),
    ).select("symbol", "_s.*")


def resume_plan(
    options: DataFrame, prices: DataFrame | None = None, universe: DataFrame | None = None
) -> DataFrame:
    """Per symbol and side: last stored date and the date to go on from.

    That is the day after the last one, moved to the next price date when prices know one; null
    when nothing is stored. ``universe`` (column ``symbol``) adds symbols without any options.
    """
    kind = side(F.col("option_type"))
    last = options.groupBy(F.col("underlying_symbol").alias("symbol")).agg(
        *[F.max(F.when(kind == s, F.col("quote_date"))).alias(f"{s}_last") for s in SIDES]
    )
    if universe is not None:
        last = universe.select("symbol").distinct().join(last, "symbol", "left")
    if prices is None:
        plan = last.withColumns({f"{s}_next": F.lit(None).cast("date") for s in SIDES})
    else:
        plan = last.withColumns({f"{s}_from": F.date_add(f"{s}_last", 1) for s in SIDES})
        dates = trading_calendar(prices, "symbol", "date")
        plan = next_dates(plan, dates, {f"{s}_from": f"{s}_next" for s in SIDES})
    plan = _both_sides(plan)
    return plan.select(
        "symbol",
        "option_type",
        "last_date",
        F.coalesce(F.col("next_trading_day"), F.date_add("last_date", 1)).alias("resume_date"),
    )


def price_resume(prices: DataFrame) -> DataFrame:
    """Per symbol: the day after the last stored price."""
    return prices.groupBy("symbol").agg(
        F.max("date").alias("last_date"), F.date_add(F.max("date"), 1).alias("resume_date")
    )


def period_for_gap(gap_days: Column, default: str) -> Column:
    """Shortest history period that covers the gap; null when up to date."""
    # Upper bounds in days and the names of the periods.
    return (
        F.when(gap_days.isNull(), default)
        .when(gap_days <= 0, None)
        .when(gap_days < 30, "1mo")
        .when(gap_days < 90, "3mo")
        .when(gap_days < 180, "6mo")
        .when(gap_days < 365, "1y")
        .otherwise("5y")
    )


def period_plan(
    prices: DataFrame, as_of: date, default: str = "5y", universe: DataFrame | None = None
) -> DataFrame:
    """Per symbol: days from the resume date to ``as_of`` and the period to load."""
    plan = price_resume(prices)
    if universe is not None:
        plan = universe.select("symbol").distinct().join(plan, "symbol", "left")
    gap = F.datediff(F.lit(as_of), F.col("resume_date"))
    return plan.select(
        "symbol",
        "resume_date",
        gap.alias("gap_days"),
        period_for_gap(gap, default).alias("period"),
        F.coalesce(gap <= 0, F.lit(False)).alias("up_to_date"),
    )
