"""Symbol lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strikelake.operators import symbols
from workload import views
from workload.registry import query


@query(
    "list_symbols",
    f"WITH {views.LISTING_QUOTES} SELECT DISTINCT underlying_symbol AS symbol FROM quotes",
)
def list_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.list_symbols(views.listing_quotes(spark, sf_dir), "underlying_symbol")


_CANDIDATES = """candidates AS (
  SELECT DISTINCT symbol FROM (
    SELECT p_name AS symbol FROM part UNION ALL SELECT p_brand FROM part
    UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT s_name FROM supplier
    UNION ALL SELECT o_orderpriority FROM orders
    UNION ALL SELECT 'c.' || c_custkey || '-x_1' FROM customer
    UNION ALL SELECT CASE WHEN n_regionkey = 1 THEN '' ELSE n_name END FROM nation))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all kinds; some hold characters that no symbol may have, one is empty."""

    def column(name: str, expression: Column) -> DataFrame:
        return views.table(spark, sf_dir, name).select(expression.alias("symbol"))

    named = (
        column("part", F.col("p_name"))
        .unionByName(column("part", F.col("p_brand")))
        .unionByName(column("part", F.lower("p_type")))
        .unionByName(column("supplier", F.col("s_name")))
        .unionByName(column("orders", F.col("o_orderpriority")))
        .unionByName(column("customer", F.concat(F.lit("c."), F.col("c_custkey"), F.lit("-x_1"))))
        .unionByName(column("nation", F.when(F.col("n_regionkey") == 1, "").otherwise(F.col("n_name"))))
    )
    return named.distinct()


@query(
    "valid_symbols",
    f"""
WITH {_CANDIDATES}
SELECT symbol, regexp_full_match(symbol, '[A-Za-z0-9._-]+') AS valid,
  CASE WHEN regexp_full_match(symbol, '[A-Za-z0-9._-]+') THEN upper(symbol) END AS clean_symbol
FROM candidates""",
)
def valid_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.check_symbols(_candidates(spark, sf_dir))


@query(
    "symbol_search",
    f"WITH {_CANDIDATES} SELECT symbol FROM candidates WHERE contains(upper(symbol), 'RE')",
)
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.search_symbols(_candidates(spark, sf_dir), "rE")


@query(
    "symbol_filter",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT underlying_symbol, quote_date, count(*) AS n FROM quotes
WHERE underlying_symbol IN ('F', 'X1') GROUP BY 1, 2""",
)
def symbol_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = views.exchange_quotes(spark, sf_dir)
    kept = symbols.restrict_symbols(quotes, ["f", "x1"], "underlying_symbol")
    return kept.groupBy("underlying_symbol", "quote_date").agg(F.count("*").alias("n"))


@query(
    "symbol_inventory",
    f"""
WITH {views.LISTING_QUOTES}, {views.LISTING_PRICES},
o AS (SELECT DISTINCT underlying_symbol AS symbol FROM quotes),
p AS (SELECT DISTINCT symbol FROM prices)
SELECT coalesce(o.symbol, p.symbol) AS symbol,
  CASE WHEN o.symbol IS NULL THEN 1 ELSE 0 END AS source_rank,
  o.symbol IS NOT NULL AS has_options, p.symbol IS NOT NULL AS has_prices
FROM o FULL JOIN p ON o.symbol = p.symbol""",
)
def symbol_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbol_inventory(
        views.listing_quotes(spark, sf_dir), views.listing_prices(spark, sf_dir)
    )
