"""Per-symbol facts: status, ranges, nulls, zeros, outliers, duplicates, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.operators import daily, facts
from strikelake.plans import quality
from workload import views
from workload.registry import query

_COVERED_DAYS = """
  SELECT underlying_symbol AS symbol, quote_date,
    count(*) AS n,
    min(CASE WHEN lower(option_type) = 'call' THEN abs(delta) END) <= 0.2
      AND max(CASE WHEN lower(option_type) = 'call' THEN abs(delta) END) >= 0.8
      AND min(CASE WHEN lower(option_type) <> 'call' THEN abs(delta) END) <= 0.2
      AND max(CASE WHEN lower(option_type) <> 'call' THEN abs(delta) END) >= 0.8 AS covered
  FROM quotes
  WHERE quote_date IS NOT NULL AND delta IS NOT NULL AND option_type IS NOT NULL
  GROUP BY 1, 2"""

DELTA_COVERAGE_SQL = f"""
WITH {views.EXCHANGE_QUOTES}, days AS ({_COVERED_DAYS}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS place,
    count(*) OVER (PARTITION BY symbol) AS n_days FROM days)
SELECT symbol, count(*) AS total_dates,
  CAST(sum(CASE WHEN covered THEN 1 ELSE 0 END) AS BIGINT) AS passing_dates,
  max(CASE WHEN place = n_days // 2 + 1 THEN n END) AS median_strikes,
  CAST(sum(CASE WHEN covered THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0
    AS coverage_pct,
  CASE WHEN CAST(sum(CASE WHEN covered THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE)
    * 100.0 >= 80.0 THEN 'PASS' ELSE 'WARN' END AS status
FROM ranked GROUP BY symbol"""


@query("delta_coverage", DELTA_COVERAGE_SQL)
def delta_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.delta_coverage(views.exchange_quotes(spark, sf_dir))


@query(
    "strikes_per_day",
    f"""
WITH {views.LISTING_QUOTES},
days AS (
  SELECT underlying_symbol AS symbol, quote_date, count(*) AS n FROM quotes
  WHERE quote_date IS NOT NULL AND delta IS NOT NULL AND option_type IS NOT NULL GROUP BY 1, 2),
ranked AS (
  SELECT symbol, n, row_number() OVER (PARTITION BY symbol ORDER BY n) AS place,
    count(*) OVER (PARTITION BY symbol) AS n_days FROM days)
SELECT symbol, n_days AS total_dates, n AS median_strikes FROM ranked WHERE place = n_days // 2 + 1""",
)
def strikes_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.strikes_per_day(views.listing_quotes(spark, sf_dir))


SHARES = {"low": (1, 10), "median_strikes": (1, 2), "high": (9, 10), "most": (1, 1)}
_AT_SHARES = ", ".join(
    f"max(CASE WHEN place - 1 = least(n_days * {part} // {whole}, n_days - 1) THEN n END) AS {name}"
    for name, (part, whole) in SHARES.items()
)


@query(
    "strikes_per_quantile",
    f"""
WITH {views.LISTING_QUOTES},
days AS (
  SELECT underlying_symbol AS symbol, quote_date, count(*) AS n FROM quotes
  WHERE quote_date IS NOT NULL AND delta IS NOT NULL AND option_type IS NOT NULL GROUP BY 1, 2),
ranked AS (
  SELECT symbol, n, row_number() OVER (PARTITION BY symbol ORDER BY n) AS place,
    count(*) OVER (PARTITION BY symbol) AS n_days FROM days)
SELECT symbol, max(n_days) AS total_dates, {_AT_SHARES} FROM ranked GROUP BY 1""",
)
def strikes_per_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.strikes_per_quantile(views.listing_quotes(spark, sf_dir), SHARES)


@query(
    "options_duplicates",
    f"""
WITH {views.EXCHANGE_QUOTES},
per_key AS (SELECT {views.KEYS}, count(*) AS copies FROM quotes GROUP BY {views.KEYS})
SELECT underlying_symbol AS symbol, CAST(sum(copies) AS BIGINT) AS n_rows, count(*) AS unique_rows,
  CAST(sum(copies) - count(*) AS BIGINT) AS duplicate_rows
FROM per_key GROUP BY 1""",
)
def options_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.options_duplicates(views.exchange_quotes(spark, sf_dir))


def _with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes with values taken out by rules on other columns, so that nulls occur."""
    q = views.exchange_quotes(spark, sf_dir)
    return q.withColumns(
        {
            "strike": F.when(F.col("bid") != 0.03, F.col("strike")),
            "option_type": F.when(F.col("ask") != 0.02, F.col("option_type")),
            "expiration": F.when(F.col("l_linenumber") != 3, F.col("expiration")),
        }
    )


@query(
    "options_nulls",
    f"""
WITH {views.EXCHANGE_QUOTES},
holes AS (
  SELECT underlying_symbol, quote_date, CASE WHEN bid <> 0.03 THEN strike END AS strike,
    CASE WHEN ask <> 0.02 THEN option_type END AS option_type,
    CASE WHEN l_linenumber <> 3 THEN expiration END AS expiration FROM quotes)
SELECT underlying_symbol AS symbol, count(*) AS n_rows,
  count(*) - count(quote_date) AS null_quote_date,
  count(*) - count(underlying_symbol) AS null_underlying_symbol,
  count(*) - count(option_type) AS null_option_type,
  count(*) - count(expiration) AS null_expiration,
  count(*) - count(strike) AS null_strike
FROM holes GROUP BY 1""",
)
def options_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.options_nulls(_with_holes(spark, sf_dir))


@query(
    "prices_nulls",
    f"""
WITH {views.EXCHANGE_PRICES},
holes AS (SELECT symbol, date, CASE WHEN volume <> 2 THEN close END AS close FROM prices)
SELECT symbol, count(*) AS n_rows, count(*) - count(date) AS null_date,
  count(*) - count(close) AS null_close
FROM holes GROUP BY 1""",
)
def prices_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = views.exchange_prices(spark, sf_dir)
    return facts.prices_nulls(prices.withColumn("close", F.when(F.col("volume") != 2, F.col("close"))))


_ZEROS = ", ".join(
    f"""CAST(count_if({c} = 0) AS BIGINT) AS zero_{c},
  CAST(count_if({c} = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS pct_{c},
  CAST(count_if({c} = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 >= 5.0 AS flag_{c}"""
    for c in ("bid", "ask", "last")
)


@query(
    "zero_prices",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT underlying_symbol AS symbol, count(*) AS n_rows, {_ZEROS}
FROM quotes GROUP BY 1""",
)
def zero_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.zero_prices(views.exchange_quotes(spark, sf_dir))


@query(
    "delta_outliers",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT underlying_symbol AS symbol, count(*) AS n_rows,
  CAST(count_if(abs(delta) > 1.0) AS BIGINT) AS delta_outliers
FROM quotes GROUP BY 1""",
)
def delta_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.delta_outliers(views.exchange_quotes(spark, sf_dir))


_LEVELS = ("open", "high", "low", "close", "adjclose")
_SHIFTED = ", ".join(f"{c} - 50000 AS {c}" for c in _LEVELS)
_NONPOSITIVE = ", ".join(
    f"""CAST(count_if({c} <= 0) AS BIGINT) AS nonpositive_{c},
  CAST(count_if({c} <= 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS pct_{c}"""
    for c in _LEVELS
)


@query(
    "prices_outliers",
    f"""
WITH {views.EXCHANGE_PRICES}, shifted AS (SELECT symbol, {_SHIFTED} FROM prices)
SELECT symbol, count(*) AS n_rows, {_NONPOSITIVE} FROM shifted GROUP BY 1""",
)
def prices_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = views.exchange_prices(spark, sf_dir)
    return facts.prices_outliers(prices.withColumns({c: F.col(c) - 50000 for c in _LEVELS}))


@query(
    "catalog_status",
    f"""
WITH {views.LISTING_QUOTES}, {views.LISTING_PRICES}
SELECT 'options' AS dataset, underlying_symbol AS symbol, count(*) AS row_count,
  min(quote_date) AS date_min, max(quote_date) AS date_max FROM quotes GROUP BY 2
UNION ALL
SELECT 'prices', symbol, count(*), min(date), max(date) FROM prices GROUP BY 2""",
)
def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = facts.catalog_status(views.listing_quotes(spark, sf_dir), "underlying_symbol", "quote_date")
    prices = facts.catalog_status(views.listing_prices(spark, sf_dir), "symbol", "date")
    return options.select(F.lit("options").alias("dataset"), "*").unionByName(
        prices.select(F.lit("prices").alias("dataset"), "*")
    )


@query(
    "date_range_summary",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT underlying_symbol AS symbol, min(expiration) AS date_min, max(expiration) AS date_max
FROM quotes GROUP BY 1""",
)
def date_range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.date_range_summary(
        views.exchange_quotes(spark, sf_dir), "underlying_symbol", "expiration"
    )


_OPTION_ISSUES = "; ".join(
    f"missing '{c}'"
    for c in (
        "open high low volume open_interest gamma theta vega rho implied_volatility "
        "midpoint moneyness theoretical dte"
    ).split()
)


@query(
    "options_schema",
    f"""
WITH {views.LISTING_QUOTES},
columns AS (SELECT count(*) AS n FROM (DESCRIBE SELECT * FROM lineitem))
SELECT DISTINCT underlying_symbol AS symbol, 'WARN' AS status, CAST(14 AS BIGINT) AS observed,
  n + 3 AS total, '{_OPTION_ISSUES.replace("'", "''")}' AS message
FROM quotes, columns""",
)
def options_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.options_schema(views.listing_quotes(spark, sf_dir))


@query(
    "prices_schema",
    f"""
WITH {views.LISTING_PRICES}
SELECT DISTINCT symbol, 'PASS' AS status, CAST(0 AS BIGINT) AS observed, CAST(7 AS BIGINT) AS total,
  'all 7 columns as expected' AS message
FROM prices""",
)
def prices_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.prices_schema(views.listing_prices(spark, sf_dir))
