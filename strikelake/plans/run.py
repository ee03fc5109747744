"""A whole load: landed pages to the lake, with the outcome per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.operators.symbols import is_valid_symbol
from strikelake.plans.loads import load_report
from strikelake.sources.envelope import is_unreadable, page_rows
from strikelake.sources.lake import Lake
from strikelake.sources.quotes import prices_from_quotes, quote_errors
from strikelake.streaming.ingest import ARRIVAL, identified_quotes, quotes_of

_TEXTS = "array<string>"


def _staged(df: DataFrame, path: str) -> DataFrame:
    """Parsed rows as Parquet: written once, then read by columns and safe from a lost executor."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _result(counts: DataFrame, provider: str, category: str) -> DataFrame:
    return counts.select(
        "symbol",
        F.lit(provider).alias("provider"),
        F.lit(category).alias("category"),
        "new_rows",
        "rejected_rows",
        "errors",
        "warnings",
    )


def _texts_when(condition: Column, text: Column) -> Column:
    return F.when(condition, F.array(text)).otherwise(F.array().cast(_TEXTS))


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Equal columns; pages without a symbol match one another."""
    tests = [a[c].eqNullSafe(b[c]) for c in columns]
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def load_pages(
    lake: Lake,
    pages: DataFrame,
    staging: str,
    providers: dict[str, str],
    price_mode: str = "merge",
) -> DataFrame:
    """Store every page and report per symbol: new and rejected rows, stored total, dates, status, message.

    ``pages`` have the envelope's columns with ``dataset``, ``symbol`` and ``page_seq`` filled in. The
    page's symbol, in any case, is that of its load: rows that name none are stored under it. Rows
    whose symbol cannot be stored are an error of their load and are kept in the lake's rejects.
    ``staging`` is a new folder that all executors reach; the report reads it, so it can go once
    the report has been used. ``providers`` names the provider of each dataset. A symbol without a
    usable quote is an error, a page that is no JSON a warning; neither stops the others.
    """
    pages = pages.withColumn("symbol", F.upper("symbol"))
    by_set = {name: pages.filter(F.col("dataset") == name) for name in ("options", "prices")}
    options = _staged(identified_quotes(by_set["options"]), f"{staging}/options")
    quotes = _staged(quotes_of(page_rows(by_set["prices"])), f"{staging}/quotes")
    lake.upsert_options(options.drop("symbol"), ARRIVAL, staged=True)
    lake.write_prices(prices_from_quotes(quotes), ARRIVAL, price_mode, staged=True)

    # One pass over the pages tells which loads were asked for and what of them cannot be read.
    asked = pages.groupBy("dataset", "symbol").agg(F.count_if(is_unreadable()).alias("n_broken"))
    warning = _texts_when(F.col("n_broken") > 0, F.format_string("%d page(s) are no JSON", "n_broken")).alias("warnings")
    refused = _texts_when(
        F.col("rejected_rows") > 0, F.format_string("%d row(s) have no usable symbol", "rejected_rows")
    )

    stored = options.groupBy("symbol").agg(
        F.count("*").alias("new_rows"),
        F.count_if(~is_valid_symbol(F.col("underlying_symbol"))).alias("rejected_rows"),
    )
    asked_options = asked.filter(F.col("dataset") == "options")
    on_options = asked_options.join(stored, _same(asked_options, stored, "symbol"), "left").select(
        asked_options["symbol"],
        F.coalesce("new_rows", F.lit(0)).alias("new_rows"),
        F.coalesce("rejected_rows", F.lit(0)).alias("rejected_rows"),
        refused.alias("errors"),
        warning,
    )
    found = quote_errors(quotes)
    asked_prices = asked.filter(F.col("dataset") == "prices")
    none_came = F.concat(F.lit("no quotes came for "), asked_prices["symbol"])
    usable = is_valid_symbol(asked_prices["symbol"])
    on_prices = (
        asked_prices.join(found, _same(asked_prices, found, "symbol"), "left")
        .withColumn("error", F.when(F.col("n_quotes").isNull(), none_came).otherwise(F.col("error")))
        .withColumn("rejected_rows", F.when(usable, F.lit(0)).otherwise(F.coalesce("n_valid", F.lit(0))))
        .select(
            asked_prices["symbol"],
            F.coalesce("n_valid", F.lit(0)).alias("new_rows"),
            F.col("rejected_rows").cast("bigint").alias("rejected_rows"),
            F.concat(_texts_when(F.col("error").isNotNull(), F.col("error")), refused).alias("errors"),
            warning,
        )
    )
    results = _result(on_options, providers["options"], "options").unionByName(
        _result(on_prices, providers["prices"], "prices")
    )
    return load_report(results, lake.status())
