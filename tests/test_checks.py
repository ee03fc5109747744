from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strikelake.operators import calendar, daily, facts, symbols
from strikelake.plans import quality
from tests.conftest import PRICE, QUOTE, bar, d, quote


def quotes(spark, rows):
    return spark.createDataFrame(rows, QUOTE)


def prices(spark, rows):
    return spark.createDataFrame(rows, PRICE)


def missing_by_definition(days: set[date]) -> list[date]:
    day, out = min(days), []
    while day <= max(days):
        if day.weekday() < 5 and day not in days:
            out.append(day)
        day += timedelta(days=1)
    return out


def runs_by_definition(missing: list[date]) -> list[tuple[date, date, int]]:
    runs: list[list] = []
    for day in missing:
        if runs and (day - runs[-1][1]).days <= (3 if runs[-1][1].weekday() == 4 else 1):
            runs[-1][1] = day
            runs[-1][2] += 1
        else:
            runs.append([day, day, 1])
    return [tuple(r) for r in runs]


def random_calendars(n: int) -> dict[str, set[date]]:
    rng = random.Random(7)
    out = {}
    for i in range(n):
        start = date(2023, 12, 20) + timedelta(days=rng.randrange(14))
        span, share = rng.randrange(1, 60), rng.choice([0.05, 0.2, 0.5, 0.9])
        days = {start + timedelta(days=k) for k in range(span) if rng.random() < share}
        out[f"S{i}"] = days or {start}
    # Only weekend dates, and weekends at both ends.
    out["WE"] = {d("2024-01-06"), d("2024-01-14")}
    out["SAT"] = {d("2024-01-06")}
    out["SATSUN"] = {d("2024-01-06"), d("2024-01-07")}
    out["ENDS"] = {d("2024-01-07"), d("2024-01-10"), d("2024-01-20")}
    return out


def test_weekday_gaps_match_the_definition(spark):
    calendars = random_calendars(150)
    rows = [(s, day) for s, days in calendars.items() for day in days] * 2
    df = spark.createDataFrame(rows, "symbol string, date date").repartition(5)
    got: dict[str, list] = {}
    for r in calendar.weekday_gaps(df).collect():
        got.setdefault(r["symbol"], []).append((r["gap_start"], r["gap_end"], r["missing_days"]))
    missing: dict[str, list] = {}
    for r in calendar.missing_weekdays(df).collect():
        missing.setdefault(r["symbol"], []).append(r["date"])
    for s, days in calendars.items():
        expected = missing_by_definition(days)
        assert sorted(missing.get(s, [])) == expected, s
        assert sorted(got.get(s, [])) == runs_by_definition(expected), s


def test_runs_of_three_and_four_across_a_weekend(spark):
    # Missing Thu, Fri, Mon; then missing Thu, Fri, Mon, Tue.
    three = ["2024-01-10", "2024-01-16"]
    four = ["2024-01-10", "2024-01-17"]
    df = prices(spark, [bar("A", x) for x in three] + [bar("B", x) for x in four])
    got = calendar.prices_gaps(df).collect()
    assert [(r["symbol"], r["gap_start"], r["gap_end"], r["missing_days"]) for r in got] == [
        ("B", d("2024-01-11"), d("2024-01-16"), 4)
    ]


def test_weekday_calendar(spark):
    df = prices(spark, [bar("A", "2024-01-05"), bar("A", "2024-01-09"), bar("A", None)])
    got = [r["date"] for r in calendar.weekday_calendar(df, "symbol", "date").orderBy("date").collect()]
    assert got == [d("2024-01-05"), d("2024-01-08"), d("2024-01-09")]


def test_options_gaps_outcomes(spark):
    week = ["2024-01-08", "2024-01-09", "2024-01-10", "2024-01-11", "2024-01-12"]
    o = [quote("OK", x) for x in week]
    o += [quote("GAP", week[0]), quote("GAP", week[4])]
    o += [quote("NOPRICE", week[0])]
    o += [quote("APART", "2023-01-02")]
    o += [quote("UNDATED", None)]
    o += [quote("MANY", "2024-01-01"), quote("MANY", "2024-01-31")]
    p = [bar(s, x) for s in ("OK", "GAP", "APART", "UNDATED", "ONLYPRICE") for x in week]
    p += [bar("MANY", f"2024-01-{n:02}") for n in range(1, 32)]
    got = {r["symbol"]: r for r in calendar.options_gaps(quotes(spark, o), prices(spark, p)).collect()}
    assert {s: r["outcome"] for s, r in got.items()} == {
        "OK": "ok",
        "GAP": "gaps",
        "NOPRICE": "no_prices",
        "APART": "no_overlap",
        "UNDATED": "no_dates",
        "MANY": "gaps",
    }
    assert (got["OK"]["trading_days"], got["OK"]["missing_days"]) == (5, 0)
    assert got["GAP"]["missing_dates"] == "2024-01-09, 2024-01-10, 2024-01-11"
    assert (got["MANY"]["missing_days"], got["MANY"]["trading_days"]) == (29, 31)
    assert got["MANY"]["missing_dates"] is None


def test_date_range_is_inclusive_and_reaches_the_scan(spark, tmp_path):
    q = quotes(spark, [quote(day=f"2024-01-{n:02}") for n in range(1, 11)])
    q.write.parquet(str(tmp_path / "q"))
    df = calendar.date_range(spark.read.parquet(str(tmp_path / "q")), "quote_date", "2024-01-03", "2024-01-05")
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(quote_date,2024-01-03)" in plan and "LessThan(quote_date,2024-01-06)" in plan


DELTAS = (0.1, 0.3, 0.5, 0.7, 0.9)


def test_delta_coverage(spark):
    rows = [quote("GOOD", kind=k, delta=x * sign) for k, sign in (("call", 1), ("put", -1)) for x in DELTAS]
    rows += [quote("CALLS", kind="call", delta=x) for x in DELTAS]
    rows += [quote("EDGE", kind=k, delta=x) for k in ("call", "put") for x in (0.2, 0.8)]
    rows += [quote("NARROW", kind=k, delta=x) for k in ("call", "put") for x in (0.21, 0.8)]
    got = {r["symbol"]: r for r in daily.delta_coverage(quotes(spark, rows)).collect()}
    assert {s: (r["passing_dates"], r["status"]) for s, r in got.items()} == {
        "GOOD": (1, "PASS"),
        "CALLS": (0, "WARN"),
        "EDGE": (1, "PASS"),
        "NARROW": (0, "WARN"),
    }
    assert got["GOOD"]["median_strikes"] == 10


def test_delta_coverage_counts_nan_rows_but_not_their_value(spark):
    nan = float("nan")
    rows = [quote("N", kind=k, delta=x) for k in ("call", "put") for x in (nan, 0.1, 0.9)]
    rows += [quote("N", day="2024-01-11", kind="call", delta=nan)]
    rows += [quote("N", day="2024-01-12", kind=None), quote("N", day=None), quote("N", day="2024-01-12", delta=None)]
    (r,) = daily.delta_coverage(quotes(spark, rows)).collect()
    assert (r["total_dates"], r["passing_dates"], r["median_strikes"]) == (2, 1, 6)


def test_median_of_an_even_number_of_days_is_the_upper(spark):
    rows = [quote(day="2024-01-10")] + [quote(day="2024-01-11", strike=float(i)) for i in range(5)]
    (r,) = daily.strikes_per_day(quotes(spark, rows)).collect()
    assert (r["total_dates"], r["median_strikes"]) == (2, 5)


def test_duplicates_treat_nulls_as_equal(spark):
    rows = [quote(strike=None), quote(strike=None), quote(), quote(), quote(), quote(kind="put"), quote("QQQ")]
    got = {r["symbol"]: (r["n_rows"], r["duplicate_rows"]) for r in facts.options_duplicates(quotes(spark, rows)).collect()}
    assert got == {"SPY": (6, 3), "QQQ": (1, 0)}
    with pytest.raises(ValueError, match="strike"):
        facts.options_duplicates(quotes(spark, rows).drop("strike"))


def test_zero_prices_flag_from_five_percent(spark):
    rows = [quote(strike=float(i), bid=0.0 if i < 1 else 1.0, ask=0.0 if i < 2 else 1.0) for i in range(40)]
    (r,) = facts.zero_prices(quotes(spark, rows)).collect()
    assert (r["zero_bid"], r["pct_bid"], r["flag_bid"]) == (1, 2.5, False)
    assert (r["zero_ask"], r["pct_ask"], r["flag_ask"]) == (2, 5.0, True)
    assert facts.zero_prices(quotes(spark, []).select("*")).count() == 0


def test_delta_outliers_skip_nan(spark):
    rows = [quote(delta=x) for x in (1.0, -1.0, 1.01, -1.5, float("nan"), None)]
    (r,) = facts.delta_outliers(quotes(spark, rows)).collect()
    assert r["delta_outliers"] == 2


def test_value_checks_skip_columns_that_are_no_doubles(spark):
    df = quotes(spark, [quote(bid=0.0)]).withColumn("bid", F.col("bid").cast("int"))
    assert "zero_bid" not in facts.zero_prices(df).columns


def test_prices_outliers(spark):
    (r,) = facts.prices_outliers(prices(spark, [bar(level=x) for x in (0.0, -1.0, 1.0, 2.0)])).collect()
    assert (r["nonpositive_close"], r["pct_close"]) == (2, 50.0)


def test_catalog_status_falls_back_between_date_columns(spark):
    p = prices(spark, [bar(day="2024-01-01"), bar(day="2024-01-03")])
    (r,) = facts.catalog_status(p, "symbol", "quote_date").collect()
    assert (r["row_count"], r["date_min"], r["date_max"]) == (2, d("2024-01-01"), d("2024-01-03"))
    (r,) = facts.catalog_status(p.drop("date"), "symbol", "quote_date").collect()
    assert (r["row_count"], r["date_min"]) == (2, None)
    (r,) = facts.date_range_summary(p.withColumn("date", F.lit("x")), "symbol", "date").collect()
    assert r["date_min"] is None


def test_symbols(spark):
    df = spark.createDataFrame([(s,) for s in ("spy", "BRK.B", "BF-B", "A_1", "a b", "", "é", None)], "symbol string")
    got = {r["symbol"]: r["clean_symbol"] for r in symbols.check_symbols(df).collect()}
    assert got == {"spy": "SPY", "BRK.B": "BRK.B", "BF-B": "BF-B", "A_1": "A_1", "a b": None, "": None, "é": None, None: None}
    good, bad = symbols.split_symbols(df)
    assert good.count() == 4 and bad.count() == 4
    listed = spark.createDataFrame([("ZZZ",), ("AAA",), ("MMM",), ("AAA",)], "s string")
    assert [r["symbol"] for r in symbols.list_symbols(listed, "s").collect()] == ["AAA", "MMM", "ZZZ"]
    assert symbols.search_symbols(df, "b").count() == 3 and symbols.search_symbols(df, None).count() == 8
    assert symbols.restrict_symbols(df, ["SPY"]).count() == 0
    assert symbols.restrict_symbols(df, ["brk.b"]).count() == 1
    assert symbols.restrict_symbols(df, []).count() == 8


def test_inventory_lists_options_symbols_first(spark):
    got = symbols.symbol_inventory(quotes(spark, [quote("Z"), quote("B")]), prices(spark, [bar("A"), bar("B")]))
    assert [(r["symbol"], r["has_options"], r["has_prices"]) for r in got.collect()] == [
        ("B", True, True),
        ("Z", True, False),
        ("A", False, True),
    ]


def report_of(spark, o, p, **kw):
    rows = quality.quality_report(o, p, **kw).orderBy("symbol", "position").collect()
    return {(r["symbol"], r["position"]): r for r in rows}


def test_report_messages(spark):
    o = [quote("SPY", "2024-01-10", strike=float(i), bid=0.0 if i == 0 else 1.0, delta=1.5 if i < 2 else 0.5) for i in range(10)]
    o += [quote("SPY", "2024-01-10", strike=9.0), quote("SPY", "2024-01-12", strike=None)]
    p = [bar("SPY", x) for x in ("2024-01-10", "2024-01-11", "2024-01-12")] + [bar("QQQ", "2024-01-01", 0.0), bar("QQQ", "2024-01-08")]
    got = report_of(spark, quotes(spark, o), prices(spark, p))
    text = {k: (r["status"], r["message"]) for k, r in got.items()}
    assert text[("SPY", 1)] == ("WARN", "1 price day(s) without quotes: 2024-01-11")
    assert text[("SPY", 2)] == ("WARN", "1 of 12 rows repeat a key")
    assert text[("SPY", 4)] == ("WARN", "strike is null in 1 row(s); zeros: bid(1, 8.3%); delta beyond 1 in 2 row(s)")
    assert text[("SPY", 5)] == ("WARN", "both sides span delta 0.2 to 0.8 on 0.0% of days, median 11 strikes")
    assert text[("SPY", 6)] == ("PASS", "all 7 columns as expected")
    assert text[("SPY", 7)] == ("PASS", "nothing found")
    assert text[("SPY", 8)] == ("PASS", "no gap of over 3 weekdays, 0 missing in all")
    assert text[("QQQ", 7)][1].startswith("open not above zero in 1 row(s) (50.0%); ")
    assert text[("QQQ", 8)] == ("WARN", "1 gap(s) of over 3 weekdays: 2024-01-02 until 2024-01-05: 4 weekdays")
    assert not [k for k in text if k[0] == "QQQ" and k[1] <= 5]


def test_report_without_prices_dates_or_columns(spark):
    p = prices(spark, [bar("B", None)])
    o = quotes(spark, [quote("A"), quote("B")])
    got = report_of(spark, o, p)
    assert got[("A", 1)]["message"] == "no price bars to compare with"
    assert got[("B", 1)]["message"] == "one side has no dates"
    assert got[("B", 7)]["message"] == "date is null in 1 row(s)"
    assert got[("B", 8)]["message"] == "no bars with a date"
    bare = report_of(spark, o.drop("delta", "strike"), p)
    assert bare[("A", 2)]["status"] == "FAIL" and "'strike'" in bare[("A", 2)]["message"]
    assert bare[("A", 5)]["message"] == "no usable delta column"
    assert bare[("A", 4)]["message"] == "nothing found"
    undated = report_of(spark, o.withColumn("quote_date", F.lit("2024")), p)
    assert undated[("A", 5)]["message"] == "no usable quote_date column"
    assert "quote_date is string, expected date" in undated[("A", 3)]["message"]


def test_report_of_listed_symbols_and_issues_only(spark):
    o, p = quotes(spark, [quote("A"), quote("B")]), prices(spark, [bar("A"), bar("B")])
    assert {k[0] for k in report_of(spark, o, p, symbols=["b"])} == {"B"}
    report = quality.quality_report(o, p)
    issues = quality.issues_only(report).collect()
    assert {r["status"] for r in issues} == {"WARN"} and {r["dataset"] for r in issues} == {"options"}
    whole = quality.issues_only(report, whole_sections=True).collect()
    assert len(whole) == 10 and {r["dataset"] for r in whole} == {"options"}


def test_schema_checks_read_no_rows(spark):
    o, p = quotes(spark, [quote()]), prices(spark, [bar()])
    assert quality.prices_schema_issues(p) == []
    assert quality.prices_schema_issues(p.drop("close")) == ["missing 'close'"]
    assert quality.prices_schema_issues(p.withColumn("open", F.lit("x"))) == ["'open' is string, expected numeric"]
    assert "missing 'gamma'" in quality.options_schema_issues(o)
    (row,) = quality.prices_schema(p).collect()
    assert (row["status"], row["total"]) == ("PASS", 7)


def test_report_of_nothing(spark):
    assert quality.quality_report(quotes(spark, []), prices(spark, [])).count() == 0
