"""Calendars and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.operators import asof, calendar
from workload import views
from workload.registry import query

# Missing weekdays per symbol by the plain definition: every weekday minus the stored dates.
MISSING_SQL = """
spans AS (SELECT symbol, min(date) AS first, max(date) AS last FROM prices GROUP BY 1),
weekdays AS (
  SELECT symbol, CAST(d AS DATE) AS date FROM (
    SELECT symbol, unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS d
    FROM spans)
  WHERE isodow(d) <= 5),
missing AS (
  SELECT w.symbol, w.date FROM weekdays w
  WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.symbol = w.symbol AND p.date = w.date))"""

# Islands of missing weekdays: Friday and Monday are neighbours.
GAPS_SQL = f"""{MISSING_SQL},
starts AS (
  SELECT symbol, date,
    CASE WHEN date - lag(date) OVER w <= CASE WHEN isodow(lag(date) OVER w) = 5 THEN 3 ELSE 1 END
      THEN 0 ELSE 1 END AS fresh
  FROM missing WINDOW w AS (PARTITION BY symbol ORDER BY date)),
islands AS (SELECT symbol, date, sum(fresh) OVER (PARTITION BY symbol ORDER BY date) AS island FROM starts),
gaps AS (
  SELECT symbol, min(date) AS gap_start, max(date) AS gap_end, count(*) AS missing_days
  FROM islands GROUP BY symbol, island)"""


@query(
    "trading_calendar",
    f"""
WITH {views.LISTING_PRICES}
SELECT DISTINCT symbol, date FROM prices WHERE date IS NOT NULL""",
)
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.trading_calendar(views.listing_prices(spark, sf_dir), "symbol", "date")


@query(
    "weekday_calendar",
    f"""
WITH {views.PRIORITY_PRICES}, {MISSING_SQL.split("missing AS")[0].rstrip().rstrip(",")}
SELECT symbol, date FROM weekdays""",
)
def weekday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.weekday_calendar(views.priority_prices(spark, sf_dir), "symbol", "date")


@query(
    "prices_gaps",
    f"""
WITH {views.LISTING_PRICES}, {GAPS_SQL}
SELECT symbol, gap_start, gap_end, missing_days FROM gaps WHERE missing_days > 3""",
)
def prices_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.prices_gaps(views.listing_prices(spark, sf_dir))


@query(
    "missing_weekdays",
    f"""
WITH {views.PRIORITY_PRICES}, {MISSING_SQL}
SELECT symbol, date FROM missing""",
)
def missing_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.missing_weekdays(views.priority_prices(spark, sf_dir))


# Options gaps per symbol, as a common table expression over quotes and prices.
OPTIONS_GAPS_SQL = """
quote_days AS (SELECT DISTINCT underlying_symbol AS symbol, quote_date AS date FROM quotes),
price_days AS (SELECT DISTINCT symbol, date FROM prices),
quote_span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM quote_days GROUP BY 1),
price_span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM price_days GROUP BY 1),
overlap AS (
  SELECT q.symbol, greatest(q.lo, p.lo) AS start, least(q.hi, p.hi) AS stop
  FROM quote_span q JOIN price_span p ON q.symbol = p.symbol),
checked AS (
  SELECT o.symbol, p.date, q.date IS NULL AS absent
  FROM overlap o
  JOIN price_days p ON p.symbol = o.symbol AND p.date BETWEEN o.start AND o.stop
  LEFT JOIN quote_days q ON q.symbol = p.symbol AND q.date = p.date),
gap_counts AS (
  SELECT symbol, count(*) AS trading_days, CAST(count_if(absent) AS BIGINT) AS missing_days,
    string_agg(CASE WHEN absent THEN CAST(date AS VARCHAR) END, ', ' ORDER BY date) AS dates
  FROM checked GROUP BY 1),
options_gaps AS (
  SELECT s.symbol,
    CASE WHEN p.symbol IS NULL THEN 'no_prices'
      WHEN o.start > o.stop THEN 'no_overlap'
      WHEN g.missing_days > 0 THEN 'gaps' ELSE 'ok' END AS outcome,
    coalesce(g.trading_days, 0) AS trading_days, coalesce(g.missing_days, 0) AS missing_days,
    CASE WHEN g.missing_days BETWEEN 1 AND 5 THEN g.dates END AS missing_dates
  FROM quote_span s
  LEFT JOIN price_span p ON p.symbol = s.symbol
  LEFT JOIN overlap o ON o.symbol = s.symbol
  LEFT JOIN gap_counts g ON g.symbol = s.symbol)"""


@query(
    "options_gaps",
    f"""
WITH {views.LISTING_QUOTES}, {views.LISTING_PRICES}, {OPTIONS_GAPS_SQL}
SELECT * FROM options_gaps""",
)
def options_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.options_gaps(views.listing_quotes(spark, sf_dir), views.listing_prices(spark, sf_dir))


@query(
    "date_range",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT {views.KEYS}, bid, ask, last, delta FROM quotes
WHERE quote_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
)
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = views.table(spark, sf_dir, "lineitem")
    ranged = calendar.date_range(lineitem, "l_shipdate", "1997-03-01", "1998-02-28")
    columns = views.KEYS.split(", ")
    return views.quotes_of(ranged).select(*columns, "bid", "ask", "last", "delta")


@query(
    "asof_forward",
    f"""
WITH {views.EXCHANGE_QUOTES}, {views.EXCHANGE_PRICES}
SELECT {views.KEYS}, last, p.date AS settles
FROM quotes q ASOF LEFT JOIN prices p ON p.symbol = q.underlying_symbol AND q.expiration <= p.date""",
)
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bar at or after each quote's expiration: as many candidates per symbol as it has quotes."""
    quotes = views.exchange_quotes(spark, sf_dir)
    candidates = quotes.select(*views.KEYS.split(", "), "last", F.col("underlying_symbol").alias("symbol"))
    met = asof.next_date(candidates, views.exchange_prices(spark, sf_dir), "expiration", "settles")
    return met.select(*views.KEYS.split(", "), "last", "settles")
