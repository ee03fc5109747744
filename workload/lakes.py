"""Queries over the lake's states: writers at once, loads beside one another, changes, batches."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.sources.lake import Lake
from workload import views
from workload.merges import BARS, SHIPMENTS, shipment_prices
from workload.registry import query

_OUT = [*views.KEYS.split(", "), "bid", "ask", "last", "delta"]
_LATEST = f"row_number() OVER (PARTITION BY {views.KEYS} ORDER BY {views.ARRIVAL_DESC}) AS recency"


@query(
    "upsert_rebased",
    f"""
WITH {views.EXCHANGE_QUOTES}, loads AS (
  SELECT * FROM quotes WHERE l_linenumber < 4
  UNION ALL
  SELECT * REPLACE (expiration + 1000 AS expiration) FROM quotes WHERE l_linenumber >= 4),
ranked AS (SELECT *, {_LATEST} FROM loads)
SELECT {", ".join(_OUT)} FROM ranked WHERE recency = 1""",
)
def upsert_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers load into the same parts at once; who commits second goes behind the first."""
    root = views.scratch_dir(spark, "rebased")
    quotes = views.exchange_quotes(spark, sf_dir)
    late = quotes.filter("l_linenumber >= 4").withColumn("expiration", F.date_add("expiration", 1000))
    loads = [quotes.filter("l_linenumber < 4"), late]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda rows: Lake(spark, root, part="year").upsert_options(rows, views.ARRIVAL), loads))
    return Lake(spark, root, part="year").scan("options").select(*_OUT)


def _two_loads(spark: SparkSession, sf_dir: str, label: str) -> Lake:
    lake = views.scratch_lake(spark, label)
    lake.write_prices(views.exchange_prices(spark, sf_dir))
    lake.write_prices(shipment_prices(spark, sf_dir))
    return lake


@query(
    "prices_delta",
    f"""
WITH {views.EXCHANGE_PRICES}, {SHIPMENTS}, merged AS (
  SELECT {BARS} FROM shipments
  UNION ALL
  SELECT {BARS} FROM prices p WHERE NOT EXISTS (
    SELECT 1 FROM shipments s WHERE s.symbol = p.symbol AND s.date = p.date))
SELECT compacted, {BARS} FROM merged, (SELECT unnest([true, false]) AS compacted)""",
)
def prices_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of two loads that lie beside one another, and the same once they are folded."""
    lake = _two_loads(spark, sf_dir, "prices-delta")
    lake.compact("prices")
    read = {flag: lake.scan("prices", snapshot=n).withColumn("compacted", F.lit(flag)) for flag, n in ((False, 2), (True, 3))}
    return read[False].unionByName(read[True]).select("compacted", *BARS.split(", "))


@query(
    "lake_changes",
    f"""
WITH {views.EXCHANGE_PRICES}, {SHIPMENTS}
SELECT 'removed' AS change, {BARS} FROM prices WHERE symbol NOT IN (SELECT symbol FROM shipments)
UNION ALL
SELECT 'inserted', {BARS} FROM shipments s WHERE NOT EXISTS (
  SELECT 1 FROM prices p WHERE s.symbol = p.symbol AND s.date = p.date)
UNION ALL
SELECT 'changed', {", ".join(f"s.{c}" for c in BARS.split(", "))}
FROM shipments s JOIN prices p ON s.symbol = p.symbol AND s.date = p.date
WHERE {" OR ".join(f"s.{c} IS DISTINCT FROM p.{c}" for c in BARS.split(", ")[2:])}""",
)
def lake_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second load and the purge of all symbols that it lacks changed."""
    lake = _two_loads(spark, sf_dir, "changes")
    stored = lake.symbols("prices")
    gone = stored.join(shipment_prices(spark, sf_dir).select("symbol").distinct(), "symbol", "left_anti")
    lake.purge(gone.withColumn("dataset", F.lit("prices")))
    return lake.changes("prices", since=1).select("change", *BARS.split(", "))


@query(
    "batch_replayed",
    f"""
WITH {views.EXCHANGE_PRICES}
SELECT symbol, count(*) AS row_count, min(date) AS date_min, max(date) AS date_max, 1 AS snapshots
FROM prices GROUP BY 1""",
)
def batch_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that comes again, with other rows even, leaves the snapshot as it is."""
    lake = views.scratch_lake(spark, "batch")
    lake.write_prices(views.exchange_prices(spark, sf_dir), batch=("orders", 0))
    lake.write_prices(shipment_prices(spark, sf_dir), batch=("orders", 0))
    found = lake.status().select("symbol", "row_count", "date_min", "date_max")
    return found.withColumn("snapshots", F.lit(len(lake.snapshots("prices"))))


_RANGES = {"quote_date": ("1995-01-01", "1995-03-31"), "strike": (10.0, 20.0), "expiration": ("1995-02-01", None)}


@query(
    "lookup_quotes",
    f"""
WITH {views.EXCHANGE_QUOTES}, loads AS (
  SELECT *, 0 AS source FROM quotes WHERE l_linenumber < 4
  UNION ALL SELECT *, 1 FROM quotes WHERE l_linenumber >= 4),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {views.KEYS} ORDER BY source DESC, {views.ARRIVAL_DESC}) AS recency
  FROM loads)
SELECT {", ".join(_OUT)} FROM ranked WHERE recency = 1 AND underlying_symbol = 'F'
  AND quote_date BETWEEN DATE '1995-01-01' AND DATE '1995-03-31' AND strike BETWEEN 10 AND 20
  AND expiration >= DATE '1995-02-01'""",
)
def lookup_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of one symbol in ranges of date, strike and expiration, from the files that may hold them."""
    lake = views.scratch_lake(spark, "lookup")
    quotes = views.exchange_quotes(spark, sf_dir)
    lake.upsert_options(quotes.filter("l_linenumber < 4"), views.ARRIVAL)
    lake.upsert_options(quotes.filter("l_linenumber >= 4"), views.ARRIVAL)
    return lake.lookup("options", "F", **_RANGES).select(*_OUT)


@query(
    "schema_promoted",
    f"""
WITH {views.EXCHANGE_QUOTES}, loads AS (
  SELECT *, 0 AS source FROM quotes WHERE l_linenumber < 4
  UNION ALL SELECT *, 1 FROM quotes WHERE l_linenumber >= 4),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {views.KEYS} ORDER BY source DESC, {views.ARRIVAL_DESC}) AS recency
  FROM loads)
SELECT {views.KEYS}, CAST(l_suppkey AS BIGINT) AS supplier, CAST(l_partkey AS VARCHAR) AS part FROM ranked WHERE recency = 1""",
)
def schema_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that the table lacked becomes part of it between two loads, and is widened."""
    lake = views.scratch_lake(spark, "promoted")
    quotes = views.exchange_quotes(spark, sf_dir).withColumns({"supplier": F.col("l_suppkey"), "part": F.col("l_partkey")})
    lake.upsert_options(quotes.filter("l_linenumber < 4"), views.ARRIVAL)
    lake.promote("options", "supplier", "int")
    lake.upsert_options(quotes.filter("l_linenumber >= 4"), views.ARRIVAL)
    lake.promote("options", "supplier", "bigint")
    return lake.scan("options").select(*views.KEYS.split(", "), "supplier", F.col("extras")["part"].alias("part"))
