"""Per-symbol facts: row counts, date ranges, nulls, zeros, outliers, duplicates.

The counting expressions are written once as lists of aggregates. A single check groups them by
symbol; the whole report groups them by symbol and day, in one pass with the coverage figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from strikelake.functions import percent
from strikelake.schemas import (
    OPTION_KEYS,
    OPTION_QUOTED_PRICES,
    OPTION_REQUIRED,
    PRICE_LEVELS,
    PRICE_REQUIRED,
)

# Fixed value: share of zero prices, in percent, from which a column is flagged.
ZERO_SHARE = 5.0


def has_type(df: DataFrame, column: str, kind: type[T.DataType]) -> bool:
    return any(f.name == column and isinstance(f.dataType, kind) for f in df.schema)


def null_counts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns if c in df.columns]


def _of_doubles(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Only double columns are tested for values; others are skipped without a word."""
    return [c for c in columns if has_type(df, c, T.DoubleType)]


def zero_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(c) == 0).alias(f"zero_{c}") for c in _of_doubles(df, OPTION_QUOTED_PRICES)]


def delta_outlier_counts(df: DataFrame) -> list[Column]:
    """|delta| > 1. Spark ranks NaN above every number, so it is taken out."""
    d = F.col("delta")
    return [
        F.count_if((F.abs(d) > 1.0) & ~F.isnan(d)).alias("delta_outliers")
        for _ in _of_doubles(df, ["delta"])
    ]


def nonpositive_counts(df: DataFrame) -> list[Column]:
    return [
        F.count_if(F.col(c) <= 0).alias(f"nonpositive_{c}") for c in _of_doubles(df, PRICE_LEVELS)
    ]


def _by_symbol(df: DataFrame, symbol: str, aggregates: list[Column]) -> DataFrame:
    return df.groupBy(F.col(symbol).alias("symbol")).agg(F.count("*").alias("n_rows"), *aggregates)


def options_nulls(df: DataFrame) -> DataFrame:
    """Nulls in the columns that must not have any."""
    return _by_symbol(df, "underlying_symbol", null_counts(df, OPTION_REQUIRED))


def prices_nulls(df: DataFrame) -> DataFrame:
    return _by_symbol(df, "symbol", null_counts(df, PRICE_REQUIRED))


def zero_prices(df: DataFrame) -> DataFrame:
    """Zeros in bid, ask and last: count, share of the rows, flag from 5 %."""
    out = _by_symbol(df, "underlying_symbol", zero_counts(df))
    for c in _of_doubles(df, OPTION_QUOTED_PRICES):
        pct = percent(F.col(f"zero_{c}"), F.col("n_rows"))
        out = out.withColumns(
            {f"pct_{c}": pct, f"flag_{c}": F.coalesce(pct >= ZERO_SHARE, F.lit(False))}
        )
    return out


def delta_outliers(df: DataFrame) -> DataFrame:
    return _by_symbol(df, "underlying_symbol", delta_outlier_counts(df))


def prices_outliers(df: DataFrame) -> DataFrame:
    """Zero or negative price levels: count and share of the rows."""
    out = _by_symbol(df, "symbol", nonpositive_counts(df))
    for c in _of_doubles(df, PRICE_LEVELS):
        out = out.withColumn(f"pct_{c}", percent(F.col(f"nonpositive_{c}"), F.col("n_rows")))
    return out


def missing_keys(df: DataFrame) -> list[str]:
    return [k for k in OPTION_KEYS if k not in df.columns]


def options_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each key, per symbol. Nulls in a key are equal.

    Copies are added up per key before anything is shuffled by symbol, so neither a symbol with
    most rows nor a key with many copies ends up in one task.
    """
    absent = missing_keys(df)
    if absent:
        raise ValueError(f"rows cannot be told apart without {absent[0]!r}")
    per_key = df.groupBy(F.col("underlying_symbol").alias("symbol"), *OPTION_KEYS).agg(
        F.count("*").alias("copies")
    )
    return per_key.groupBy("symbol").agg(
        F.sum("copies").alias("n_rows"),
        F.count("*").alias("unique_rows"),
        (F.sum("copies") - F.count("*")).alias("duplicate_rows"),
    )


def date_column(df: DataFrame, wanted: str) -> str | None:
    """The requested column, else ``date``, else ``quote_date``, else none."""
    return next((c for c in (wanted, "date", "quote_date") if c in df.columns), None)


def _range(df: DataFrame, column: str | None) -> list[Column]:
    usable = column is not None and has_type(df, column, T.DateType)
    day = F.col(column) if usable else F.lit(None).cast("date")
    return [F.min(day).alias("date_min"), F.max(day).alias("date_max")]


def catalog_status(df: DataFrame, symbol: str, wanted_date: str) -> DataFrame:
    """Row count and date range per symbol; only the symbol and one date column are read."""
    return df.groupBy(F.col(symbol).alias("symbol")).agg(
        F.count("*").alias("row_count"), *_range(df, date_column(df, wanted_date))
    )


def date_range_summary(df: DataFrame, symbol: str, column: str) -> DataFrame:
    """First and last date per symbol; null when the column is absent or no date."""
    return df.groupBy(F.col(symbol).alias("symbol")).agg(
        *_range(df, column if column in df.columns else None)
    )
