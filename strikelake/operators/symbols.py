"""Symbol lists: validity, search, restriction, inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: what a symbol may consist of.
SYMBOL_PATTERN = r"\A[A-Za-z0-9._-]+\z"


def is_valid_symbol(symbol: Column) -> Column:
    return F.coalesce(symbol.rlike(SYMBOL_PATTERN), F.lit(False))


def check_symbols(df: DataFrame, column: str = "symbol") -> DataFrame:
    """Adds ``valid`` and the upper-cased ``clean_symbol``, null for an invalid one."""
    valid = is_valid_symbol(F.col(column))
    return df.withColumns({"valid": valid, "clean_symbol": F.when(valid, F.upper(F.col(column)))})


def split_symbols(df: DataFrame, column: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Rows with a valid symbol, upper-cased, and the rejected rows as they came."""
    valid = is_valid_symbol(F.col(column))
    return (
        df.filter(valid).withColumn(column, F.upper(F.col(column))),
        df.filter(~valid),
    )


def list_symbols(df: DataFrame, column: str) -> DataFrame:
    """Distinct symbols in order."""
    return df.select(F.col(column).alias("symbol")).distinct().orderBy("symbol")


def search_symbols(df: DataFrame, query: str | None, column: str = "symbol") -> DataFrame:
    """Rows whose symbol contains ``query`` in any case; all rows without a query."""
    if query is None:
        return df
    return df.filter(F.contains(F.upper(F.col(column)), F.upper(F.lit(query))))


def restrict_symbols(df: DataFrame, symbols: Sequence[str] | None, column: str = "symbol") -> DataFrame:
    """Rows of the listed symbols, all rows for an empty list.

    The list is upper-cased and the stored names are not. The test reaches the scan as a
    partition filter.
    """
    if not symbols:
        return df
    return df.filter(F.col(column).isin(*[s.upper() for s in symbols]))


def symbol_inventory(options: DataFrame, prices: DataFrame) -> DataFrame:
    """Every stored symbol once with where it occurs: options symbols first, each set sorted."""
    seen = (
        options.select(F.col("underlying_symbol").alias("symbol"), F.lit(0).alias("source"))
        .unionByName(prices.select("symbol", F.lit(1).alias("source")))
        .groupBy("symbol")
        .agg(
            F.min("source").alias("source_rank"),
            (F.min("source") == 0).alias("has_options"),
            (F.max("source") == 1).alias("has_prices"),
        )
    )
    return seen.orderBy("source_rank", "symbol")
