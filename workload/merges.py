"""Union, keep-last, and the lake's writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.operators import merge
from strikelake.plans.quality import stored_schema
from strikelake.sources.lake import purge_outcome, purge_rows
from strikelake.sources.symbol_files import read_symbol_files, symbol_file_status
from workload import views
from workload.facts import catalog_status
from workload.registry import query

_VALUES = ("bid", "ask", "last", "delta")
_OUT = [*views.KEYS.split(", "), *_VALUES]
_OUT_SQL = ", ".join(_OUT)
_LATEST = f"row_number() OVER (PARTITION BY {views.KEYS} ORDER BY {views.ARRIVAL_DESC}) AS recency"


@query(
    "dedup_keep_last",
    f"""
WITH {views.EXCHANGE_QUOTES}, ranked AS (SELECT *, {_LATEST} FROM quotes)
SELECT {_OUT_SQL} FROM ranked WHERE recency = 1""",
)
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = views.exchange_quotes(spark, sf_dir)
    return merge.keep_last(quotes, views.KEYS.split(", "), views.ARRIVAL).select(*_OUT)


def _text_chunk(quotes: DataFrame) -> DataFrame:
    """The quotes as a chunk that lacks columns, has one of its own, and holds text."""
    return quotes.select(
        "underlying_symbol",
        F.col("quote_date").cast("string").alias("quote_date"),
        F.concat(F.col("expiration").cast("string"), F.lit(" 00:00:00")).alias("expiration"),
        F.when(F.col("strike") == 13, "n/a").otherwise(F.col("strike").cast("string")).alias("strike"),
        "option_type",
        F.col("l_linenumber").cast("bigint").alias("bid"),
        F.lit("late").alias("venue"),
    )


@query(
    "merge_union",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT underlying_symbol, quote_date, expiration, strike, option_type, expiration_type, bid, ask,
  CAST(NULL AS VARCHAR) AS venue, 0 AS source_rank FROM quotes
UNION ALL
SELECT underlying_symbol, quote_date, expiration, CASE WHEN strike <> 13 THEN strike END, option_type,
  NULL, CAST(l_linenumber AS DOUBLE), NULL, 'late', 1 FROM quotes""",
)
def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = views.exchange_quotes(spark, sf_dir)
    columns = [*views.KEYS.split(", "), "bid", "ask"]
    merged = merge.union_chunks([quotes.select(*columns), _text_chunk(quotes)])
    return merged.withColumnRenamed(merge.STORED_FIRST, "source_rank")


def _corrections(quotes: DataFrame) -> DataFrame:
    """A second load of all quotes: bids raised, expiry a week later, so that keys overlap in part."""
    return quotes.withColumns({"bid": F.col("bid") + 1, "expiration": F.date_add("expiration", 7)})


def upsert_sql(option_type: str = "option_type") -> str:
    """Two loads, the second winning, with the latest arrival of each key."""
    return f"""
WITH {views.EXCHANGE_QUOTES},
loads AS (
  SELECT * REPLACE ({option_type} AS option_type), 0 AS source FROM quotes
  UNION ALL
  SELECT * REPLACE ({option_type} AS option_type, bid + 1 AS bid, expiration + 7 AS expiration), 1
  FROM quotes),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {views.KEYS} ORDER BY source DESC, {views.ARRIVAL_DESC})
    AS recency FROM loads)
SELECT {_OUT_SQL} FROM ranked WHERE recency = 1"""


@query("options_upsert", upsert_sql())
def options_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = views.scratch_lake(spark, "options-upsert")
    quotes = views.exchange_quotes(spark, sf_dir)
    lake.upsert_options(quotes, views.ARRIVAL)
    lake.upsert_options(_corrections(quotes), views.ARRIVAL)
    return lake.scan("options").select(*_OUT)


@query(
    "scan_quotes",
    f"""
WITH {views.EXCHANGE_QUOTES}, ranked AS (SELECT *, {_LATEST} FROM quotes)
SELECT underlying_symbol, quote_date, option_type, count(*) AS n, max(strike) AS top_strike
FROM ranked WHERE recency = 1 GROUP BY 1, 2, 3""",
)
def scan_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = views.scratch_lake(spark, "scan-quotes")
    lake.upsert_options(views.exchange_quotes(spark, sf_dir), views.ARRIVAL)
    return (
        lake.scan("options")
        .groupBy("underlying_symbol", "quote_date", "option_type")
        .agg(F.count("*").alias("n"), F.max("strike").alias("top_strike"))
    )


BARS = "symbol, date, open, high, low, close, adjclose, volume"


def shipment_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source of bars, for the symbols O and F only."""
    return views.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_linestatus").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(
        *[F.max("l_extendedprice").alias(c) for c in ("open", "high", "close", "adjclose")],
        F.min("l_extendedprice").alias("low"),
        F.count("*").alias("volume"),
    )


SHIPMENTS = """shipments AS (
  SELECT l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS open,
    max(l_extendedprice) AS high, min(l_extendedprice) AS low, max(l_extendedprice) AS close,
    max(l_extendedprice) AS adjclose, count(*) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def _two_price_loads(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    lake = views.scratch_lake(spark, f"prices-{mode}")
    lake.write_prices(views.exchange_prices(spark, sf_dir), mode=mode)
    lake.write_prices(shipment_prices(spark, sf_dir), mode=mode)
    return lake.scan("prices").select(*BARS.split(", "))


@query(
    "prices_overwrite",
    f"""
WITH {views.EXCHANGE_PRICES}, {SHIPMENTS}
SELECT {BARS} FROM shipments
UNION ALL
SELECT {BARS} FROM prices WHERE symbol NOT IN (SELECT symbol FROM shipments)""",
)
def prices_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_price_loads(spark, sf_dir, "overwrite")


@query(
    "prices_merge",
    f"""
WITH {views.EXCHANGE_PRICES}, {SHIPMENTS}
SELECT {BARS} FROM shipments
UNION ALL
SELECT {BARS} FROM prices p WHERE NOT EXISTS (
  SELECT 1 FROM shipments s WHERE s.symbol = p.symbol AND s.date = p.date)""",
)
def prices_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_price_loads(spark, sf_dir, "merge")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt lose their options, the poorest segment also its prices."""
    customer = views.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") < 0)
    kinds = F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("options"), F.lit("prices")))
    return customer.select(
        F.col("c_custkey").cast("string").alias("symbol"),
        F.explode(F.coalesce(kinds, F.array(F.lit("options")))).alias("dataset"),
    )


_REQUESTS = """requests AS (
  SELECT CAST(c_custkey AS VARCHAR) AS symbol, 'options' AS dataset FROM customer WHERE c_acctbal < 0
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), 'prices' FROM customer
  WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING')"""


@query(
    "purge",
    f"""
WITH {views.LISTING_QUOTES}, {views.LISTING_PRICES}, {_REQUESTS},
stored AS (
  SELECT 'options' AS dataset, underlying_symbol AS symbol, count(*) AS n FROM quotes GROUP BY 2
  UNION ALL SELECT 'prices', symbol, count(*) FROM prices GROUP BY 2)
SELECT r.dataset, r.symbol, coalesce(s.n, 0) AS rows_removed,
  CASE WHEN s.n IS NULL THEN 'nothing stored under this symbol' END AS warning
FROM requests r LEFT JOIN stored s ON s.dataset = r.dataset AND s.symbol = r.symbol""",
)
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purge_outcome(catalog_status(spark, sf_dir), _requests(spark, sf_dir))


@query(
    "purge_rows",
    f"""
WITH {views.LISTING_PRICES}, {_REQUESTS}
SELECT {BARS} FROM prices
WHERE symbol NOT IN (SELECT symbol FROM requests WHERE dataset = 'prices')""",
)
def purged_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = views.listing_prices(spark, sf_dir)
    return purge_rows(prices, _requests(spark, sf_dir), "prices").select(*BARS.split(", "))


@query(
    "lake_status",
    f"""
WITH {views.EXCHANGE_PRICES}
SELECT 'prices' AS dataset, symbol, count(*) AS row_count, min(date) AS date_min, max(date) AS date_max,
  true AS has_bytes
FROM prices WHERE symbol IN (SELECT l_linestatus FROM lineitem) GROUP BY 2""",
)
def lake_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all order states are stored; states that no line has are purged; the rest is listed."""
    lake = views.scratch_lake(spark, "status")
    lake.write_prices(views.exchange_prices(spark, sf_dir))
    shipped = views.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("symbol"))
    unshipped = (
        views.table(spark, sf_dir, "orders")
        .select(F.col("o_orderstatus").alias("symbol"))
        .distinct()
        .join(shipped.distinct(), "symbol", "left_anti")
    )
    lake.purge(unshipped.withColumn("dataset", F.lit("prices")))
    return lake.status().select(
        "dataset", "symbol", "row_count", "date_min", "date_max", (F.col("size_bytes") > 0).alias("has_bytes")
    )


@query("lake_expired", upsert_sql())
def lake_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after two loads, once what no snapshot uses is gone."""
    lake = views.scratch_lake(spark, "expired")
    quotes = views.exchange_quotes(spark, sf_dir)
    lake.upsert_options(quotes, views.ARRIVAL)
    lake.upsert_options(_corrections(quotes), views.ARRIVAL)
    lake.expire("options")
    return lake.scan("options").select(*_OUT)


@query(
    "upsert_extras",
    f"""
WITH {views.EXCHANGE_QUOTES},
loads AS (
  SELECT *, 0 AS source FROM quotes WHERE l_linenumber < 4
  UNION ALL SELECT *, 1 FROM quotes WHERE l_linenumber >= 4),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {views.KEYS} ORDER BY source DESC, {views.ARRIVAL_DESC})
    AS recency FROM loads)
SELECT {views.KEYS}, last, CASE WHEN source = 0 THEN CAST(l_suppkey AS VARCHAR) END AS venue
FROM ranked WHERE recency = 1""",
)
def upsert_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load with a column that the table lacks, then one without it: the column survives the merge."""
    lake = views.scratch_lake(spark, "extras")
    quotes = views.exchange_quotes(spark, sf_dir)
    early = quotes.filter("l_linenumber < 4").withColumn("venue", F.col("l_suppkey"))
    lake.upsert_options(early, views.ARRIVAL)
    lake.upsert_options(quotes.filter("l_linenumber >= 4"), views.ARRIVAL)
    return lake.scan("options").select(*views.KEYS.split(", "), "last", F.col("extras")["venue"].alias("venue"))


@query(
    "lake_schema",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT underlying_symbol AS symbol,
  CASE WHEN underlying_symbol = 'O' THEN 15 ELSE 14 END AS n_missing,
  underlying_symbol = 'O' AS lacks_bid, 'WARN' AS status
FROM quotes GROUP BY 1""",
)
def lake_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of different columns give their symbols different verdicts, from the manifest alone."""
    lake = views.scratch_lake(spark, "schema")
    quotes = views.exchange_quotes(spark, sf_dir)
    lake.upsert_options(quotes.filter("underlying_symbol = 'O'").drop("bid"), views.ARRIVAL)
    lake.upsert_options(quotes.filter("underlying_symbol <> 'O'"), views.ARRIVAL)
    verdicts = stored_schema(lake, "options")
    return verdicts.select(
        "symbol", F.col("observed").alias("n_missing"), F.contains("message", F.lit("'bid'")).alias("lacks_bid"), "status"
    )


@query(
    "purge_options",
    f"""
WITH {views.EXCHANGE_QUOTES}, ranked AS (SELECT *, {_LATEST} FROM quotes)
SELECT {_OUT_SQL} FROM ranked WHERE recency = 1 AND underlying_symbol <> (SELECT min(l_linestatus) FROM lineitem)""",
)
def purge_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of all symbols are stored, those of the first one purged, the rest read."""
    lake = views.scratch_lake(spark, "purge-options")
    lake.upsert_options(views.exchange_quotes(spark, sf_dir), views.ARRIVAL)
    first = views.table(spark, sf_dir, "lineitem").agg(F.min("l_linestatus").alias("symbol"))
    lake.purge(first.withColumn("dataset", F.lit("options")))
    return lake.scan("options").select(*_OUT)


def _symbol_files(spark: SparkSession, sf_dir: str) -> str:
    """Bars of all order states, one file each: F with typed columns, O with text, P with another date column."""
    root = views.scratch_dir(spark, "symbol-files")
    bars = views.exchange_prices(spark, sf_dir).repartition(1, "symbol")
    plain = [F.col(c) for c in BARS.split(", ")[1:]]
    forms = {
        "F": plain,
        "O": [c.cast("string") for c in plain],
        "P": [F.col("date").alias("quote_date"), *plain[1:5]],
    }
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for symbol, columns in forms.items():
        bars.filter(F.col("symbol") == symbol).select(*columns).coalesce(1).write.parquet(f"{root}/parts/{symbol}")
        folder = hadoop(f"{root}/parts/{symbol}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        (part,) = [x.getPath() for x in fs.globStatus(hadoop(f"{root}/parts/{symbol}/part-*.parquet"))]
        fs.mkdirs(hadoop(f"{root}/prices"))
        fs.rename(part, hadoop(f"{root}/prices/{symbol}.parquet"))
    return root


@query(
    "symbol_file_rows",
    f"""
WITH {views.EXCHANGE_PRICES}
SELECT symbol, date, open, high, low, close,
  CASE WHEN symbol <> 'P' THEN adjclose END AS adjclose, CASE WHEN symbol <> 'P' THEN volume END AS volume
FROM prices""",
)
def symbol_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of differing columns and types as one table."""
    return read_symbol_files(spark, _symbol_files(spark, sf_dir), "prices").select(*BARS.split(", "))


@query(
    "symbol_file_status",
    f"""
WITH {views.EXCHANGE_PRICES}
SELECT symbol, count(*) AS row_count, min(date) AS date_min, max(date) AS date_max, true AS has_bytes
FROM prices GROUP BY 1""",
)
def file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = symbol_file_status(spark, _symbol_files(spark, sf_dir), "prices")
    return status.select("symbol", "row_count", "date_min", "date_max", (F.col("size_bytes") > 0).alias("has_bytes"))
