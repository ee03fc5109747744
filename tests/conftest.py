from __future__ import annotations

import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("strikelake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def d(text: str) -> date:
    return date.fromisoformat(text)


QUOTE = (
    "underlying_symbol string, quote_date date, expiration date, strike double, option_type string, "
    "expiration_type string, bid double, ask double, last double, delta double, seq bigint"
)


def quote(symbol="SPY", day="2024-01-10", strike=100.0, kind="call", seq=0, **over):
    """One quote in the column order of ``QUOTE``."""
    row = {
        "underlying_symbol": symbol,
        "quote_date": day and d(day),
        "expiration": d("2024-02-16"),
        "strike": strike,
        "option_type": kind,
        "expiration_type": "standard",
        "bid": 1.0,
        "ask": 2.0,
        "last": 1.5,
        "delta": 0.5,
        "seq": seq,
    }
    row.update(over)
    return tuple(row.values())


PRICE = (
    "symbol string, date date, open double, high double, low double, close double, "
    "adjclose double, volume bigint"
)


def bar(symbol="SPY", day="2024-01-10", level=100.0, volume=1000):
    return (symbol, day and d(day), level, level, level, level, level, volume)
