"""The whole quality report, with its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.plans import quality, quality_state
from workload import views
from workload.calendars import GAPS_SQL, OPTIONS_GAPS_SQL
from workload.facts import _COVERED_DAYS, _OPTION_ISSUES
from workload.registry import query

_LEVELS = ("open", "high", "low", "close", "adjclose")


def _joined(parts: list[str], separator: str = "; ") -> str:
    """SQL of a text list without its nulls."""
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '{separator}')"


def _percent(part: str, whole: str) -> str:
    return f"printf('%.1f', CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0)"


_ZEROS = [
    f"""CASE WHEN CAST(zero_{c} AS DOUBLE) / CAST(n AS DOUBLE) * 100.0 >= 5.0
    THEN '{c}(' || zero_{c} || ', ' || {_percent(f'zero_{c}', 'n')} || '%)' END"""
    for c in ("bid", "ask", "last")
]
_ZERO_LIST = _joined(_ZEROS, ", ")
_OPTION_FACTS = [
    f"CASE WHEN null_{c} > 0 THEN '{c} is null in ' || null_{c} || ' row(s)' END"
    for c in ("quote_date", "underlying_symbol", "option_type", "expiration", "strike")
] + [
    f"CASE WHEN {_ZERO_LIST} <> '' THEN 'zeros: ' || {_ZERO_LIST} END",
    "CASE WHEN outliers > 0 THEN 'delta beyond 1 in ' || outliers || ' row(s)' END",
]
_PRICE_FACTS = [
    f"CASE WHEN null_{c} > 0 THEN '{c} is null in ' || null_{c} || ' row(s)' END" for c in ("date", "close")
] + [
    f"""CASE WHEN bad_{c} > 0 THEN '{c} not above zero in ' || bad_{c} || ' row(s) (' ||
    {_percent(f'bad_{c}', 'n')} || '%)' END"""
    for c in _LEVELS
]


def _issue_count(parts: list[str]) -> str:
    return f"CAST(len(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)) AS BIGINT)"


def report_sql(quotes: str, prices: str, where: str = "") -> str:
    """Every check by its plain definition, one SELECT each."""
    return f"""
WITH {quotes}, {prices}, {OPTIONS_GAPS_SQL}, {GAPS_SQL},
copies AS (SELECT {views.KEYS}, count(*) AS n FROM quotes GROUP BY {views.KEYS}),
duplicates AS (
  SELECT underlying_symbol AS symbol, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - count(*) AS BIGINT) AS d
  FROM copies GROUP BY 1),
option_facts AS (
  SELECT underlying_symbol AS symbol, count(*) AS n,
    count(*) - count(quote_date) AS null_quote_date,
    count(*) - count(underlying_symbol) AS null_underlying_symbol,
    count(*) - count(option_type) AS null_option_type,
    count(*) - count(expiration) AS null_expiration, count(*) - count(strike) AS null_strike,
    count_if(bid = 0) AS zero_bid, count_if(ask = 0) AS zero_ask, count_if(last = 0) AS zero_last,
    count_if(abs(delta) > 1.0) AS outliers
  FROM quotes GROUP BY 1),
covered_days AS ({_COVERED_DAYS}),
ranked_days AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS place,
    count(*) OVER (PARTITION BY symbol) AS n_days FROM covered_days),
coverage AS (
  SELECT symbol, count(*) AS days, CAST(count_if(covered) AS BIGINT) AS passing,
    max(CASE WHEN place = n_days // 2 + 1 THEN n END) AS median
  FROM ranked_days GROUP BY 1),
price_facts AS (
  SELECT symbol, count(*) AS n, count(*) - count(date) AS null_date, count(*) - count(close) AS null_close,
    {', '.join(f'count_if({c} <= 0) AS bad_{c}' for c in _LEVELS)}
  FROM prices GROUP BY 1),
price_gaps AS (
  SELECT f.symbol, coalesce(CAST(sum(g.missing_days) AS BIGINT), 0) AS missing,
    CAST(coalesce(sum(CASE WHEN g.missing_days > 3 THEN 1 END), 0) AS BIGINT) AS long_gaps,
    string_agg(CASE WHEN g.missing_days > 3
      THEN g.gap_start || ' until ' || g.gap_end || ': ' || g.missing_days || ' weekdays' END, '; '
      ORDER BY g.gap_start) AS gap_list
  FROM price_facts f LEFT JOIN gaps g ON g.symbol = f.symbol GROUP BY 1),
lineitem_columns AS (SELECT count(*) + 3 AS n FROM (DESCRIBE SELECT * FROM lineitem)),
report AS (
  SELECT symbol, 'options' AS dataset, 1 AS position, 'Gaps' AS "check",
    CASE outcome WHEN 'ok' THEN 'PASS' ELSE 'WARN' END AS status,
    missing_days AS observed, trading_days AS total,
    CASE outcome WHEN 'no_prices' THEN 'no price bars to compare with'
      WHEN 'no_overlap' THEN 'quotes and bars do not overlap in time'
      WHEN 'ok' THEN 'every one of ' || trading_days || ' price days has quotes'
      ELSE CASE WHEN missing_days <= 5
        THEN missing_days || ' price day(s) without quotes: ' || missing_dates
        ELSE missing_days || ' of ' || trading_days || ' price days without quotes' END END AS message
  FROM options_gaps
  UNION ALL
  SELECT symbol, 'options', 2, 'Duplicates', CASE WHEN d > 0 THEN 'WARN' ELSE 'PASS' END, d, n,
    CASE WHEN d = 0 THEN 'all ' || n || ' rows differ in their keys'
      ELSE d || ' of ' || n || ' rows repeat a key' END
  FROM duplicates
  UNION ALL
  SELECT o.symbol, 'options', 3, 'Schema', 'WARN', 14, c.n, '{_OPTION_ISSUES.replace("'", "''")}'
  FROM option_facts o, lineitem_columns c
  UNION ALL
  SELECT symbol, 'options', 4, 'Nulls/Outliers',
    CASE WHEN {_issue_count(_OPTION_FACTS)} > 0 THEN 'WARN' ELSE 'PASS' END,
    {_issue_count(_OPTION_FACTS)}, n,
    CASE WHEN {_issue_count(_OPTION_FACTS)} = 0 THEN 'nothing found' ELSE {_joined(_OPTION_FACTS)} END
  FROM option_facts
  UNION ALL
  SELECT symbol, 'options', 5, 'Delta Coverage',
    CASE WHEN CAST(passing AS DOUBLE) / CAST(days AS DOUBLE) * 100.0 >= 80.0 THEN 'PASS' ELSE 'WARN' END,
    passing, days,
    'both sides span delta 0.2 to 0.8 on ' || {_percent('passing', 'days')} || '% of days, median ' || median || ' strikes'
  FROM coverage
  UNION ALL
  SELECT symbol, 'prices', 6, 'Schema', 'PASS', 0, 7, 'all 7 columns as expected' FROM price_facts
  UNION ALL
  SELECT symbol, 'prices', 7, 'Nulls/Outliers',
    CASE WHEN {_issue_count(_PRICE_FACTS)} > 0 THEN 'WARN' ELSE 'PASS' END,
    {_issue_count(_PRICE_FACTS)}, n,
    CASE WHEN {_issue_count(_PRICE_FACTS)} = 0 THEN 'nothing found' ELSE {_joined(_PRICE_FACTS)} END
  FROM price_facts
  UNION ALL
  SELECT symbol, 'prices', 8, 'Gaps', CASE WHEN long_gaps > 0 THEN 'WARN' ELSE 'PASS' END,
    long_gaps, missing,
    CASE WHEN long_gaps = 0 THEN 'no gap of over 3 weekdays, ' || missing || ' missing in all'
      ELSE long_gaps || ' gap(s) of over 3 weekdays: ' || gap_list END
  FROM price_gaps)
SELECT * FROM report {where}"""


@query("quality_report", report_sql(views.LISTING_QUOTES, views.LISTING_PRICES))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(
        views.listing_quotes(spark, sf_dir), views.listing_prices(spark, sf_dir)
    )


@query(
    "issues_only",
    report_sql(views.EXCHANGE_QUOTES, views.EXCHANGE_PRICES, "WHERE status <> 'PASS'"),
)
def issues_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issues_only(
        quality.quality_report(
            views.exchange_quotes(spark, sf_dir), views.exchange_prices(spark, sf_dir)
        )
    )


@query(
    "issue_sections",
    report_sql(
        views.EXCHANGE_QUOTES,
        views.EXCHANGE_PRICES,
        """WHERE (symbol, dataset) IN (SELECT (symbol, dataset) FROM report WHERE status <> 'PASS')""",
    ),
)
def issue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(
        views.exchange_quotes(spark, sf_dir), views.exchange_prices(spark, sf_dir)
    )
    return quality.issues_only(report, whole_sections=True)


_KEPT_QUOTES = f"""raw AS ({views.EXCHANGE_QUOTES.partition("AS (")[2][:-1]}),
ranked_quotes AS (
  SELECT *, row_number() OVER (PARTITION BY {views.KEYS} ORDER BY l_linenumber >= 4 DESC, {views.ARRIVAL_DESC}) AS recency
  FROM raw),
quotes AS (SELECT * FROM ranked_quotes WHERE recency = 1)"""
_KEPT_PRICES = f"""every_price AS ({views.EXCHANGE_PRICES.partition("AS (")[2][:-1]}),
prices AS (SELECT * FROM every_price WHERE symbol IN (SELECT l_linestatus FROM lineitem))"""
_STORED_SCHEMA = (
    "SELECT o.symbol, 'options', 3, 'Schema', 'PASS', 0, 25, 'all 25 columns as expected'\n  FROM option_facts o\n  UNION ALL"
)


def _stored_report_sql() -> str:
    """The same definitions over what a lake holds, whose schema is whole."""
    before, _, rest = report_sql(_KEPT_QUOTES, _KEPT_PRICES).partition("SELECT o.symbol, 'options', 3")
    return before + _STORED_SCHEMA + rest.partition("UNION ALL")[2]


@query("quality_report_incremental", _stored_report_sql())
def quality_report_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report after a first load, then one after another load and a purge, from what those changed."""
    lake = views.scratch_lake(spark, "quality")
    quotes = views.exchange_quotes(spark, sf_dir)
    lake.upsert_options(quotes.filter("l_linenumber < 4"), views.ARRIVAL)
    lake.write_prices(views.exchange_prices(spark, sf_dir))
    quality_state.QualityState(lake).refresh()
    lake.upsert_options(quotes.filter("l_linenumber >= 4"), views.ARRIVAL)
    shipped = quotes.select(F.col("underlying_symbol").alias("symbol")).distinct()
    gone = lake.symbols("prices").join(shipped, "symbol", "left_anti")
    lake.purge(gone.withColumn("dataset", F.lit("prices")))
    return quality_state.quality_report_incremental(lake)
