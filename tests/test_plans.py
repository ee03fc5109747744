from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strikelake.operators import strikes
from strikelake.plans import loads, resume, windows
from tests.conftest import PRICE, QUOTE, bar, d, quote


def quotes(spark, rows):
    return spark.createDataFrame(rows, QUOTE)


def prices(spark, rows):
    return spark.createDataFrame(rows, PRICE)


def plan_of(df):
    return {(r["symbol"], r["option_type"]): r["resume_date"] for r in df.collect()}


def test_resume_dates(spark):
    o = [quote("A", "2024-01-19"), quote("A", "2024-01-18", kind="PUT"), quote("A", "2024-01-30", kind="x")]
    o += [quote("B", "2024-01-19", kind="C"), quote("H", "2024-03-28"), quote("N", None)]
    p = [bar("B", "2024-01-19"), bar("B", "2024-01-23"), bar("B", "2024-01-22"), bar("H", "2024-03-28"), bar("H", "2024-04-01")]
    universe = spark.createDataFrame([(s,) for s in ("A", "B", "H", "N", "NEW")], "symbol string")
    got = plan_of(resume.resume_plan(quotes(spark, o), prices(spark, p), universe))
    assert got == {
        ("A", "call"): d("2024-01-20"),
        ("A", "put"): d("2024-01-19"),
        ("B", "call"): d("2024-01-22"),
        ("B", "put"): None,
        ("H", "call"): d("2024-04-01"),
        ("H", "put"): None,
        ("N", "call"): None,
        ("N", "put"): None,
        ("NEW", "call"): None,
        ("NEW", "put"): None,
    }
    assert plan_of(resume.resume_plan(quotes(spark, o)))[("B", "call")] == d("2024-01-20")


@pytest.mark.parametrize(
    ("last", "period"),
    [
        ("2024-05-31", None),
        ("2024-06-02", None),
        ("2024-05-30", "1mo"),
        ("2024-05-02", "1mo"),
        ("2024-05-01", "3mo"),
        ("2024-04-01", "3mo"),
        ("2024-03-02", "6mo"),
        ("2023-12-03", "1y"),
        ("2023-06-02", "1y"),
        ("2023-06-01", "5y"),
    ],
)
def test_period_for_gap(spark, last, period):
    (r,) = resume.period_plan(prices(spark, [bar("A", last)]), d("2024-06-01"), "5y").collect()
    assert r["period"] == period and r["up_to_date"] == (period is None)


def test_period_without_prices_is_the_callers(spark):
    universe = spark.createDataFrame([("NEW",)], "symbol string")
    (r,) = resume.period_plan(prices(spark, []), d("2024-06-01"), "3mo", universe).collect()
    assert (r["period"], r["up_to_date"]) == ("3mo", False)


def windows_by_definition(start: date, end: date):
    out, cur = [], end
    while cur >= start:
        begin = max(cur - timedelta(days=30), start)
        out.append((begin, cur))
        cur = begin - timedelta(days=1)
    return out


def test_windows_match_the_definition(spark):
    end = d("2024-03-01")
    starts = [end - timedelta(days=n) for n in (*range(0, 70), 92, 93, 94, 730)] + [end + timedelta(days=1)]
    plan = spark.createDataFrame([(f"S{i}", "call", s) for i, s in enumerate(starts)], "symbol string, option_type string, resume_date date")
    got: dict[str, list] = {}
    for r in windows.load_windows(plan, end).orderBy("window_no").collect():
        got.setdefault(r["symbol"], []).append((r["window_from"], r["window_to"]))
    for i, s in enumerate(starts):
        assert got.get(f"S{i}", []) == windows_by_definition(s, end)


def test_spans(spark):
    plan = spark.createDataFrame([("A", "call", d("2024-01-05")), ("B", "put", None)], "symbol string, option_type string, resume_date date")

    def spans(*args):
        return {r["symbol"]: (r["start"], r["end"]) for r in windows.load_spans(plan, *args).collect()}

    as_of = d("2024-01-10")
    assert spans(as_of) == {"A": (d("2024-01-05"), as_of), "B": (d("2022-01-10"), as_of)}
    assert spans(as_of, d("2024-01-01"), d("2024-01-02")) == {s: (d("2024-01-01"), d("2024-01-02")) for s in "AB"}
    assert spans(d("2024-01-04")) == {"B": (d("2022-01-04"), d("2024-01-04"))}
    with pytest.raises(ValueError):
        windows.load_spans(plan, as_of, None, as_of)
    with pytest.raises(ValueError):
        windows.load_spans(plan, as_of, as_of, d("2024-01-01"))


def halves(lo: date, hi: date, counts: dict, cap: int, closes: set):
    n = sum(c for day, c in counts.items() if lo <= day <= hi)
    span = (hi - lo).days
    if span == 0 and lo in closes:
        return [(lo, hi, n, "strike_band")]
    if n > cap and span <= 1:
        return [(lo, hi, n, "incomplete")]
    if n <= cap:
        return [(lo, hi, n, "fits")]
    mid = lo + timedelta(days=span // 2)
    return halves(lo, mid, counts, cap, closes) + halves(mid + timedelta(days=1), hi, counts, cap, closes)


def test_split_matches_the_definition(spark):
    rng = random.Random(11)
    end, cap, rows, plan, p, expected = d("2024-03-01"), 10, [], [], [], {}
    for i in range(40):
        s, start = f"S{i}", end - timedelta(days=rng.randrange(0, 80))
        counts = {start + timedelta(days=k): rng.choice([0, 0, 1, 4, 25]) for k in range((end - start).days + 1)}
        closes = {x for x in counts if rng.random() < 0.5}
        plan.append((s, "call", start))
        p += [bar(s, str(x), 10.0) for x in closes]
        for day, c in counts.items():
            rows += [quote(s, str(day), strike=float(k)) for k in range(c)]
        expected[s] = sorted(
            leaf for lo, hi in windows_by_definition(start, end) for leaf in halves(lo, hi, counts, cap, closes)
        )
    o = quotes(spark, [*rows, quote("S0", "2020-01-01"), quote("S0", "2024-03-01", kind="put")])
    w = windows.load_spans(spark.createDataFrame(plan, "symbol string, option_type string, resume_date date"), end)
    leaves = windows.split_windows(w, windows.side_day_counts(o), prices(spark, p), cap)
    got: dict[str, list] = {}
    for r in leaves.collect():
        got.setdefault(r["symbol"], []).append((r["load_from"], r["load_to"], r["n_rows"], r["outcome"]))
        assert (r["strike_low"] is not None) == (r["outcome"] == "strike_band")
    assert {s: sorted(x) for s, x in got.items()} == expected
    assert {x[3] for leaf in expected.values() for x in leaf} == {"fits", "incomplete", "strike_band"}
    unpriced = windows.split_windows(w, windows.side_day_counts(o), None, cap)
    assert unpriced.columns == leaves.columns and unpriced.filter("outcome = 'strike_band'").count() == 0


def test_split_on_both_axes_matches_the_definition(spark):
    """Single days with a close: rows and outcome of each half of the band, halved on while too full."""
    draw = random.Random(4)
    end, cap, days = d("2024-03-01"), 6, [d("2024-02-29"), d("2024-03-01")]
    strikes_of = {day: [draw.choice([None, 1.0, 34.9, 35.0, 60.0, 92.5, 149.9, 150.0, 150.01, 200.0, 265.0, 400.0]) for _ in range(60)] for day in days}
    rows = [quote("A", str(day), strike=k) for day, ks in strikes_of.items() for k in ks]
    plan = spark.createDataFrame([("A", "call", day) for day in days] + [("B", "call", end)], "symbol string, option_type string, resume_date date")
    spans = windows.load_spans(plan, end).filter("start = end")
    p = prices(spark, [bar("A", str(end), 100.0), bar("B", str(end), 100.0)])
    o = quotes(spark, rows)

    def halves(name, lo, hi, closed, depth):
        n = sum(k is not None and (lo < k <= hi or (closed and k == lo)) for k in strikes_of[end])
        if n > cap and depth > 1:
            middle = (lo + hi) / 2
            return halves(name, lo, middle, closed, depth - 1) + halves(name, middle, hi, False, depth - 1)
        return [(name, lo, hi, n, "incomplete" if n > cap else "fits")]

    for depth in (1, 2, 4):
        leaves = windows.split_windows(spans, windows.side_day_counts(o), p, cap, windows.strike_grid(o), depth)
        got = {(r["symbol"], r["strike_part"], r["strike_low"], r["strike_high"], r["n_rows"], r["outcome"]) for r in leaves.collect()}
        want = halves("lower", 35.0, 150.0, True, depth) + halves("upper", 150.0, 265.0, False, depth)
        rest = len(strikes_of[end]) - sum(k is not None and 35.0 <= k <= 265.0 for k in strikes_of[end])
        want.append(("outside", None, None, rest, "incomplete" if rest > cap else "fits"))
        empty = {("B", "lower", 35.0, 150.0, 0, "fits"), ("B", "upper", 150.0, 265.0, 0, "fits"), ("B", "outside", None, None, 0, "fits")}
        assert got == {("A", *w) for w in want} | empty
    with pytest.raises(ValueError):
        windows.split_windows(spans, windows.side_day_counts(o), None, cap, windows.strike_grid(o))


def test_strike_band(spark):
    rows = [quote(strike=s) for s in (34.9, 35.0, 150.0, 150.005, 150.01, 265.0, 265.1)] + [quote("X", strike=1.0)]
    p = prices(spark, [bar(level=100.0), bar(level=200.0, day=None), ("SPY", d("2024-01-10"), 1.0, 1.0, 1.0, None, 1.0, 1)])
    got = {(r["underlying_symbol"], r["strike"]): r["band"] for r in strikes.strike_band(quotes(spark, rows), p).collect()}
    assert got == {
        ("SPY", 34.9): "outside",
        ("SPY", 35.0): "lower",
        ("SPY", 150.0): "lower",
        ("SPY", 150.005): "upper",
        ("SPY", 150.01): "upper",
        ("SPY", 265.0): "upper",
        ("SPY", 265.1): "outside",
        ("X", 1.0): None,
    }


def test_close_is_the_first_in_the_given_order(spark):
    p = prices(spark, [bar(level=5.0), bar(level=3.0)]).withColumn("seq", -F.col("close"))
    assert strikes.close_by_day(p, ["seq"]).first()["close"] == 5.0
    assert strikes.close_by_day(p).first()["close"] == 3.0


RESULT = "symbol string, provider string, category string, new_rows bigint, errors array<string>, warnings array<string>"


def test_load_plan(spark):
    universe = spark.createDataFrame([("spy",), ("SPY",), ("qqq",)], "symbol string")
    providers = [("a", "options"), ("b", "prices")]
    got = {(r["provider"], r["symbol"]) for r in loads.load_plan(universe, providers).collect()}
    assert got == {(p, s) for p in "ab" for s in ("SPY", "QQQ")}
    assert loads.load_plan(universe, providers, "prices").count() == 2
    with pytest.raises(ValueError):
        loads.load_plan(universe, providers, "bonds")


def test_load_report_and_rows_loaded(spark):
    sides = spark.createDataFrame(
        [("SPY", "call", 3, None), ("SPY", "put", 4, "cap hit"), ("QQQ", "call", 0, "a"), ("QQQ", "put", 0, "b")],
        "symbol string, option_type string, new_rows bigint, error string",
    )
    got = {r["symbol"]: (r["new_rows"], r["warnings"]) for r in loads.rows_loaded(sides).collect()}
    assert got == {"SPY": (7, ["put: cap hit"]), "QQQ": (0, ["call: a", "put: b"])}
    results = spark.createDataFrame(
        [
            ("SPY", "x", "options", 7, [], ["w1", "w2"]),
            ("QQQ", "x", "options", 0, ["e1", "e2"], ["w"]),
            ("IWM", "y", "prices", 1, [], []),
        ],
        RESULT,
    )
    catalog = spark.createDataFrame(
        [("options", "SPY", 100, d("2024-01-01"), d("2024-02-01")), ("prices", "SPY", 5, None, None)],
        "dataset string, symbol string, row_count bigint, date_min date, date_max date",
    )
    got = {r["symbol"]: (r["total_rows"], r["status"], r["message"]) for r in loads.load_report(results, catalog).collect()}
    assert got == {"SPY": (100, "WARNING", "w1; w2"), "QQQ": (0, "FAILED", "e1; e2"), "IWM": (0, "OK", "")}


@pytest.mark.parametrize(
    ("failures", "failed", "message"),
    [
        ([], "all", "every load failed"),
        ([0, 0], "none", None),
        ([1, 0, 0], "some", "1 of 3 loads failed"),
        ([1, 1], "all", "every load failed"),
    ],
)
def test_verdict(spark, failures, failed, message):
    rows = [("S", "p", "prices", 0, ["e"] * f, ["w"]) for f in failures]
    (r,) = loads.load_verdict(spark.createDataFrame(rows, RESULT)).collect()
    assert (r["failed"], r["message"]) == (failed, message)
