"""The test tables seen as options quotes and price bars, in Spark and in SQL.

Two views of each. The *exchange* view has two or three symbols with very many rows each
(line status, order status), the *listing* view has a symbol per part or customer, so that the
number of symbols grows with the data. All of them read their whole table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strikelake.sources.lake import Lake

# Arrival order of the quotes; with the keys it covers every column, so ties are equal rows.
ARRIVAL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "last", "bid", "ask")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quotes(lineitem: DataFrame, symbol: Column) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    flag = F.col("l_returnflag")
    return lineitem.select(
        symbol.alias("underlying_symbol"),
        day.alias("quote_date"),
        F.date_add(day, F.col("l_linenumber") * 7).alias("expiration"),
        F.col("l_quantity").alias("strike"),
        F.when(flag == "A", "Call").when(flag == "R", "PUT").otherwise("put").alias("option_type"),
        F.when(F.col("l_suppkey") % 2 == 0, "standard").otherwise("weekly").alias("expiration_type"),
        F.col("l_discount").alias("bid"),
        F.col("l_tax").alias("ask"),
        F.col("l_extendedprice").alias("last"),
        (F.col("l_quantity") / 48.0).alias("delta"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


def _prices(orders: DataFrame, symbol: Column) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return orders.groupBy(symbol.alias("symbol"), F.col("o_orderdate").cast("date").alias("date")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.max_by(price, key).alias("adjclose"),
        F.count("*").alias("volume"),
    )


def quotes_of(lineitem: DataFrame) -> DataFrame:
    return _quotes(lineitem, F.col("l_linestatus"))


def exchange_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes_of(table(spark, sf_dir, "lineitem"))


def exchange_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(table(spark, sf_dir, "orders"), F.col("o_orderstatus"))


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over four tasks a core.

    For rows that a page of JSON is made of each: files are packed by their bytes into hardly more tasks
    than there are cores, and a second round of few tasks would keep all others waiting.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def listing_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(table(spark, sf_dir, "lineitem"), F.col("l_partkey").cast("string"))


def listing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(table(spark, sf_dir, "orders"), F.col("o_custkey").cast("string"))


def priority_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(table(spark, sf_dir, "orders"), F.col("o_orderpriority"))


def _quotes_sql(symbol: str) -> str:
    return f"""
  SELECT {symbol} AS underlying_symbol, CAST(l_shipdate AS DATE) AS quote_date,
    CAST(l_shipdate AS DATE) + CAST(l_linenumber * 7 AS INT) AS expiration,
    l_quantity AS strike,
    CASE l_returnflag WHEN 'A' THEN 'Call' WHEN 'R' THEN 'PUT' ELSE 'put' END AS option_type,
    CASE WHEN l_suppkey % 2 = 0 THEN 'standard' ELSE 'weekly' END AS expiration_type,
    l_discount AS bid, l_tax AS ask, l_extendedprice AS last,
    l_quantity / CAST(48 AS DOUBLE) AS delta,
    l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem"""


def _prices_sql(symbol: str) -> str:
    return f"""
  SELECT {symbol} AS symbol, CAST(o_orderdate AS DATE) AS date,
    min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    max_by(o_totalprice, o_orderkey) AS close, max_by(o_totalprice, o_orderkey) AS adjclose,
    count(*) AS volume
  FROM orders GROUP BY 1, 2"""


# Common table expressions, to be put after WITH.
EXCHANGE_QUOTES = f"quotes AS ({_quotes_sql('l_linestatus')})"
EXCHANGE_PRICES = f"prices AS ({_prices_sql('o_orderstatus')})"
LISTING_QUOTES = f"quotes AS ({_quotes_sql('CAST(l_partkey AS VARCHAR)')})"
LISTING_PRICES = f"prices AS ({_prices_sql('CAST(o_custkey AS VARCHAR)')})"
PRIORITY_PRICES = f"prices AS ({_prices_sql('o_orderpriority')})"
ARRIVAL_DESC = ", ".join(f"{c} DESC" for c in ARRIVAL)
KEYS = "underlying_symbol, quote_date, expiration, strike, option_type, expiration_type"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the one that all executors share.

    On one machine a temporary folder does where none is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strikelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def scratch_lake(spark: SparkSession, label: str) -> Lake:
    """A new lake. By year: the test tables have few option rows per symbol and month."""
    return Lake(spark, scratch_dir(spark, label), part="year")
