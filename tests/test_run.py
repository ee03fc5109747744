from __future__ import annotations

import json

from strikelake.plans.loads import load_verdict
from strikelake.plans.run import load_pages
from strikelake.schemas import ENVELOPE_SCHEMA
from strikelake.sources.lake import Lake
from tests.conftest import d

NAMES = ["underlying_symbol", "type", "exp_date", "tradetime", "strike", "bid"]
PROVIDERS = {"options": "chains", "prices": "bars"}


def options_page(symbol, seq, *rows):
    return ("options", symbol, seq, (NAMES,), json.dumps(list(rows)), (None,))


def row(symbol, day, strike, bid):
    return [symbol, "Call", "2024-03-15", day, strike, bid]


def price_page(symbol, *quotes):
    data = [
        {"timestamp": ts, "open": c, "high": c, "low": c, "close": c, "adjclose": c, "volume": 1} for ts, c in quotes
    ]
    return ("prices", symbol, 0, (None,), json.dumps(data), (None,))


def test_load_pages(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    bad_time = -(2**63)
    pages = [
        options_page("SPY", 1, row("SPY", "2024-01-15", "1", "5"), row("SPY", "2024-01-16", "1", "6")),
        options_page("SPY", 2, row("SPY", "2024-01-15", "1", "9")),
        ("options", "QQQ", 1, (NAMES,), "[[", (None,)),
        price_page("SPY", (1704067200, 10.0), (1704153600, 11.0), (bad_time, 1.0)),
        price_page("IWM", (bad_time, 1.0)),
        price_page("NONE"),
    ]
    df = spark.createDataFrame(pages, ENVELOPE_SCHEMA)
    report = load_pages(lake, df, str(tmp_path / "staging"), PROVIDERS)
    got = {
        (r["category"], r["symbol"]): (r["provider"], r["new_rows"], r["total_rows"], r["status"], r["message"])
        for r in report.collect()
    }
    assert got == {
        ("options", "SPY"): ("chains", 3, 2, "OK", ""),
        ("options", "QQQ"): ("chains", 0, 0, "WARNING", "1 page(s) are no JSON"),
        ("prices", "SPY"): ("bars", 2, 2, "OK", ""),
        ("prices", "IWM"): ("bars", 0, 0, "FAILED", "no quote of IWM has a usable time"),
        ("prices", "NONE"): ("bars", 0, 0, "FAILED", "no quotes came for NONE"),
    }
    bids = {str(r["quote_date"]): r["bid"] for r in lake.scan("options").collect()}
    assert bids == {"2024-01-15": 9.0, "2024-01-16": 6.0}
    spy = next(r for r in report.collect() if (r["category"], r["symbol"]) == ("prices", "SPY"))
    assert (spy["date_min"], spy["date_max"]) == (d("2024-01-01"), d("2024-01-02"))


def test_a_load_loses_no_row(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    nameless = ("options", "qqq", 1, (NAMES[1:],), json.dumps([["Put", "2024-04-19", "2024-02-05", "7", "3"]] * 2), (None,))
    pages = [
        nameless,
        options_page("iwm", 1, row("iwm", "2024-02-06", "4", "1"), row("Iwm", "2024-02-07", "4", "1")),
        options_page("BRK/B", 1, row("BRK/B", "2024-02-06", "2", "2")),
        options_page("DIA", 1, row("DIA", "2024-02-06", "2", "2"), row("D A", "2024-02-06", "2", "2")),
        price_page("x y", (1704067200, 3.0)),
        ("options", None, 1, (NAMES[1:],), json.dumps([["Put", "2024-04-19", "2024-02-05", "7", "3"]]), (None,)),
    ]
    report = load_pages(lake, spark.createDataFrame(pages, ENVELOPE_SCHEMA), str(tmp_path / "staging"), PROVIDERS)
    got = {r["symbol"]: (r["new_rows"], r["rejected_rows"], r["total_rows"], r["status"]) for r in report.collect()}
    assert got == {
        "QQQ": (2, 0, 1, "OK"),
        "IWM": (2, 0, 2, "OK"),
        "BRK/B": (1, 1, 0, "FAILED"),
        "DIA": (2, 1, 1, "FAILED"),
        "X Y": (1, 1, 0, "FAILED"),
        None: (1, 1, 0, "FAILED"),
    }
    kept = [(r["underlying_symbol"], r["reason"]) for r in lake.rejects("options").collect()]
    assert sorted(kept, key=str) == sorted([("BRK/B", "invalid symbol"), ("D A", "invalid symbol"), (None, "no symbol")], key=str)
    assert [r["reason"] for r in lake.rejects("prices").collect()] == ["invalid symbol"]
    new, rejected = (sum(x[i] for x in got.values()) for i in (0, 1))
    assert new - rejected - 1 == sum(x[2] for x in got.values())  # one of the two equal rows goes


def test_load_of_nothing_is_a_failed_load(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    report = load_pages(lake, spark.createDataFrame([], ENVELOPE_SCHEMA), str(tmp_path / "staging"), PROVIDERS)
    assert report.count() == 0 and lake.status().count() == 0
    none = spark.createDataFrame([], "errors array<string>")
    assert load_verdict(none).first()["failed"] == "all"
