"""Load planning: resume dates, periods, windows, splits, strike bands, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.operators import strikes
from strikelake.plans import loads, resume, windows
from workload import views
from workload.facts import catalog_status
from workload.registry import query

AS_OF = date(2001, 12, 1)
_AS_OF = "DATE '2001-12-01'"

RESUME_SQL = """
sides AS (SELECT 'call' AS option_type UNION ALL SELECT 'put'),
universe AS (SELECT DISTINCT underlying_symbol AS symbol FROM quotes),
lasts AS (
  SELECT underlying_symbol AS symbol,
    CASE lower(substring(option_type, 1, 1)) WHEN 'c' THEN 'call' WHEN 'p' THEN 'put' END AS option_type,
    max(quote_date) AS last_date
  FROM quotes GROUP BY 1, 2),
plan AS (
  SELECT u.symbol, s.option_type, l.last_date,
    coalesce(
      (SELECT min(p.date) FROM prices p WHERE p.symbol = u.symbol AND p.date >= l.last_date + 1),
      l.last_date + 1) AS resume_date
  FROM universe u CROSS JOIN sides s
  LEFT JOIN lasts l ON l.symbol = u.symbol AND l.option_type = s.option_type)"""


@query(
    "resume_plan",
    f"""
WITH {views.LISTING_QUOTES}, {views.LISTING_PRICES}, {RESUME_SQL}
SELECT * FROM plan""",
)
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.resume_plan(views.listing_quotes(spark, sf_dir), views.listing_prices(spark, sf_dir))


@query(
    "period_plan",
    f"""
WITH {views.LISTING_PRICES},
universe AS (SELECT CAST(p_partkey AS VARCHAR) AS symbol FROM part),
plan AS (
  SELECT u.symbol, max(p.date) + 1 AS resume_date FROM universe u
  LEFT JOIN prices p ON p.symbol = u.symbol GROUP BY 1),
gaps AS (SELECT *, CAST({_AS_OF} - resume_date AS INT) AS gap_days FROM plan)
SELECT symbol, resume_date, gap_days,
  CASE WHEN gap_days IS NULL THEN '1y' WHEN gap_days <= 0 THEN NULL WHEN gap_days < 30 THEN '1mo'
    WHEN gap_days < 90 THEN '3mo' WHEN gap_days < 180 THEN '6mo' WHEN gap_days < 365 THEN '1y'
    ELSE '5y' END AS period,
  coalesce(gap_days <= 0, false) AS up_to_date
FROM gaps""",
)
def period_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("symbol"))
    return resume.period_plan(views.listing_prices(spark, sf_dir), AS_OF, "1y", universe)


def _windows_sql(spans: str, source: str) -> str:
    """Recursive form of the windows: from the end back, each starting a day before the last."""
    return f"""
{spans} AS (SELECT symbol, option_type, {source}),
walk AS (
  SELECT symbol, option_type, 0 AS window_no, start, stop AS window_to,
    greatest(stop - 30, start) AS window_from
  FROM {spans} WHERE start <= stop
  UNION ALL
  SELECT symbol, option_type, window_no + 1, start, window_from - 1,
    greatest(window_from - 31, start)
  FROM walk WHERE window_from - 1 >= start)"""


@query(
    "load_windows",
    f"""
WITH RECURSIVE {views.LISTING_QUOTES}, {views.LISTING_PRICES}, {RESUME_SQL},
{_windows_sql("spans", f"coalesce(resume_date, {_AS_OF} - 730) AS start, {_AS_OF} AS stop FROM plan")}
SELECT symbol, option_type, window_no, window_from, window_to FROM walk""",
)
def load_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.load_windows(resume_plan(spark, sf_dir), AS_OF)


ROW_CAP = 20


@query(
    "split_windows",
    f"""
WITH RECURSIVE {views.EXCHANGE_QUOTES}, {views.EXCHANGE_PRICES},
pairs AS (
  SELECT DISTINCT underlying_symbol AS symbol, s.option_type
  FROM quotes CROSS JOIN (SELECT 'call' AS option_type UNION ALL SELECT 'put') s),
{_windows_sql("spans", f"(SELECT min(quote_date) FROM quotes) AS start, {_AS_OF} AS stop FROM pairs")},
day_counts AS (
  SELECT underlying_symbol AS symbol,
    CASE lower(substring(option_type, 1, 1)) WHEN 'c' THEN 'call' ELSE 'put' END AS option_type,
    quote_date AS date, count(*) AS n
  FROM quotes GROUP BY 1, 2, 3),
running AS (
  SELECT symbol, option_type, date,
    CAST(sum(n) OVER (PARTITION BY symbol, option_type ORDER BY date) AS BIGINT) AS total
  FROM (
    SELECT p.symbol, p.option_type, CAST(d.day AS DATE) AS date, coalesce(c.n, 0) AS n
    FROM pairs p
    CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '1990-12-31', TIMESTAMP '2001-12-01',
      INTERVAL 1 DAY)) AS day) d
    LEFT JOIN day_counts c ON c.symbol = p.symbol AND c.option_type = p.option_type
      AND c.date = CAST(d.day AS DATE))),
tree AS (
  SELECT w.symbol, w.option_type, w.window_no, w.window_from AS lo, w.window_to AS hi,
    b.total - a.total AS n_rows
  FROM walk w
  JOIN running a ON a.symbol = w.symbol AND a.option_type = w.option_type AND a.date = w.window_from - 1
  JOIN running b ON b.symbol = w.symbol AND b.option_type = w.option_type AND b.date = w.window_to
  UNION ALL
  SELECT h.symbol, h.option_type, h.window_no, h.lo, h.hi, b.total - a.total
  FROM (
    SELECT t.symbol, t.option_type, t.window_no,
      CASE half WHEN 0 THEN t.lo ELSE t.lo + CAST((t.hi - t.lo) // 2 AS INT) + 1 END AS lo,
      CASE half WHEN 0 THEN t.lo + CAST((t.hi - t.lo) // 2 AS INT) ELSE t.hi END AS hi
    FROM tree t CROSS JOIN (SELECT 0 AS half UNION ALL SELECT 1)
    WHERE t.hi - t.lo > 1 AND t.n_rows > {ROW_CAP}) h
  JOIN running a ON a.symbol = h.symbol AND a.option_type = h.option_type AND a.date = h.lo - 1
  JOIN running b ON b.symbol = h.symbol AND b.option_type = h.option_type AND b.date = h.hi),
leaves AS (
  SELECT t.*, CASE WHEN t.lo = t.hi THEN p.close * 0.0001::DOUBLE END AS close FROM tree t
  LEFT JOIN prices p ON p.symbol = t.symbol AND p.date = t.lo
  WHERE t.hi - t.lo <= 1 OR t.n_rows <= {ROW_CAP}),
banded AS (
  SELECT *, close * 0.35::DOUBLE AS low, (close * 0.35::DOUBLE + close * 2.65::DOUBLE) / 2 AS mid,
    close * 2.65::DOUBLE AS high FROM leaves WHERE close IS NOT NULL),
halves AS (
  SELECT b.*, count(*) FILTER (q.strike BETWEEN low AND mid) AS n_lower,
    count(*) FILTER (q.strike > mid AND q.strike <= high) AS n_upper
  FROM banded b LEFT JOIN quotes q ON q.underlying_symbol = b.symbol AND q.quote_date = b.lo
    AND CASE lower(substring(q.option_type, 1, 1)) WHEN 'c' THEN 'call' ELSE 'put' END = b.option_type
  GROUP BY ALL),
parts AS (
  SELECT symbol, option_type, window_no, lo, hi, NULL AS strike_part, CAST(NULL AS DOUBLE) AS strike_low,
    CAST(NULL AS DOUBLE) AS strike_high, n_rows FROM leaves WHERE close IS NULL
  UNION ALL SELECT symbol, option_type, window_no, lo, hi, 'lower', low, mid, n_lower FROM halves
  UNION ALL SELECT symbol, option_type, window_no, lo, hi, 'upper', mid, high, n_upper FROM halves
  UNION ALL SELECT symbol, option_type, window_no, lo, hi, 'outside', NULL, NULL, n_rows - n_lower - n_upper FROM halves)
SELECT symbol, option_type, window_no, lo AS load_from, hi AS load_to, strike_part, strike_low, strike_high, n_rows,
  CASE WHEN n_rows > {ROW_CAP} THEN 'incomplete' ELSE 'fits' END AS outcome
FROM parts""",
)
def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows halved by day, single days with a close by strike; closes are scaled to the strikes' size."""
    quotes = views.exchange_quotes(spark, sf_dir)
    first = quotes.agg(F.min("quote_date")).first()[0]
    spans = windows.load_spans(resume.resume_plan(quotes), AS_OF, first)
    prices = views.exchange_prices(spark, sf_dir).withColumn("close", F.col("close") * 0.0001)
    return windows.split_windows(
        spans, windows.side_day_counts(quotes), prices, ROW_CAP, windows.strike_grid(quotes)
    )


@query(
    "strike_band",
    f"""
WITH {views.EXCHANGE_QUOTES}, {views.EXCHANGE_PRICES},
joined AS (
  SELECT q.*, p.close * 0.0001::DOUBLE AS close FROM quotes q
  LEFT JOIN prices p ON p.symbol = q.underlying_symbol AND p.date = q.quote_date)
SELECT {views.KEYS}, last, close,
  CASE WHEN close IS NULL THEN NULL
    WHEN strike BETWEEN close * 0.35::DOUBLE AND (close * 0.35::DOUBLE + close * 2.65::DOUBLE) / 2
      THEN 'lower'
    WHEN strike > (close * 0.35::DOUBLE + close * 2.65::DOUBLE) / 2
      AND strike <= close * 2.65::DOUBLE THEN 'upper'
    ELSE 'outside' END AS band
FROM joined""",
)
def strike_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = views.exchange_prices(spark, sf_dir).withColumn("close", F.col("close") * 0.0001)
    banded = strikes.strike_band(views.exchange_quotes(spark, sf_dir), prices)
    return banded.select(*views.KEYS.split(", "), "last", "close", "band")


PROVIDERS = (("chains", "options"), ("bars", "prices"), ("bars-backup", "prices"))


@query(
    "load_plan",
    """
SELECT provider, 'prices' AS category, symbol FROM (
  SELECT DISTINCT upper(symbol) AS symbol FROM (
    SELECT p_name AS symbol FROM part UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer))
CROSS JOIN (SELECT 'bars' AS provider UNION ALL SELECT 'bars-backup')""",
)
def load_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    universe = (
        views.table(spark, sf_dir, "part")
        .select(F.col("p_name").alias("symbol"))
        .unionByName(
            views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("symbol"))
        )
    )
    return loads.load_plan(universe, PROVIDERS, "prices")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a load as its tasks would report them, made from what each symbol has.

    Options give a warning per side with over 15 rows; price loads with few bars have failed.
    """
    side = F.when(F.lower("option_type") == "call", "call").otherwise("put")
    per_side = (
        views.listing_quotes(spark, sf_dir)
        .groupBy(F.col("underlying_symbol").alias("symbol"), side.alias("option_type"))
        .agg(F.count("*").alias("new_rows"))
        .withColumn("error", F.when(F.col("new_rows") > 15, "row limit reached"))
    )
    none = F.array().cast("array<string>")
    options = loads.rows_loaded(per_side).select(
        "symbol",
        F.lit("chains").alias("provider"),
        F.lit("options").alias("category"),
        "new_rows",
        none.alias("errors"),
        "warnings",
    )
    bars = views.listing_prices(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    failed = F.array(F.lit("no answer"), F.lit("timeout"))
    prices = bars.select(
        "symbol",
        F.lit("bars").alias("provider"),
        F.lit("prices").alias("category"),
        F.when(F.col("n") < 6, F.lit(0).cast("bigint")).otherwise(F.col("n")).alias("new_rows"),
        F.when(F.col("n") < 6, failed).otherwise(none).alias("errors"),
        none.alias("warnings"),
    )
    return options.unionByName(prices)


@query(
    "load_report",
    f"""
WITH {views.LISTING_QUOTES}, {views.LISTING_PRICES},
sides AS (
  SELECT underlying_symbol AS symbol,
    CASE WHEN lower(option_type) = 'call' THEN 'call' ELSE 'put' END AS option_type,
    count(*) AS n, min(quote_date) AS lo, max(quote_date) AS hi
  FROM quotes GROUP BY 1, 2),
o AS (
  SELECT symbol, CAST(sum(n) AS BIGINT) AS n, min(lo) AS lo, max(hi) AS hi,
    string_agg(CASE WHEN n > 15 THEN option_type || ': row limit reached' END, '; ' ORDER BY option_type) AS w
  FROM sides GROUP BY 1),
p AS (SELECT symbol, count(*) AS n, min(date) AS lo, max(date) AS hi FROM prices GROUP BY 1)
SELECT symbol, 'chains' AS provider, 'options' AS category, n AS new_rows, n AS total_rows,
  lo AS date_min, hi AS date_max, CASE WHEN w IS NULL THEN 'OK' ELSE 'WARNING' END AS status,
  coalesce(w, '') AS message FROM o
UNION ALL
SELECT symbol, 'bars', 'prices', CASE WHEN n < 6 THEN 0 ELSE n END, n, lo, hi,
  CASE WHEN n < 6 THEN 'FAILED' ELSE 'OK' END, CASE WHEN n < 6 THEN 'no answer; timeout' ELSE '' END
FROM p""",
)
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.load_report(_results(spark, sf_dir), catalog_status(spark, sf_dir))


@query(
    "load_verdict",
    f"""
WITH {views.LISTING_QUOTES}, {views.LISTING_PRICES},
p AS (SELECT symbol, count(*) AS n FROM prices GROUP BY 1),
loads AS (
  SELECT false AS failed FROM (SELECT DISTINCT underlying_symbol FROM quotes)
  UNION ALL SELECT n < 6 FROM p),
counts AS (SELECT count(*) AS n_loads, CAST(count_if(failed) AS BIGINT) AS n_failed FROM loads)
SELECT n_loads, n_failed,
  CASE WHEN n_failed = n_loads THEN 'all' WHEN n_failed > 0 THEN 'some' ELSE 'none' END AS failed,
  CASE WHEN n_failed = n_loads THEN 'every load failed'
    WHEN n_failed > 0 THEN n_failed || ' of ' || n_loads || ' loads failed' END AS message
FROM counts""",
)
def load_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.load_verdict(_results(spark, sf_dir))
