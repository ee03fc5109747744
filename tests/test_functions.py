from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from strikelake import functions as fn
from strikelake.schemas import dataset


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_parse_date_takes_full_iso_dates_only(spark):
    texts = ["2024-03-15", "2024-03-15 10:00:00", "2024", "2024-3-15", "2024-13-01", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["v"] for r in df.select(fn.parse_date(F.col("t")).alias("v")).collect()]
    assert got == [date(2024, 3, 15)] * 2 + [None] * 5


def test_parse_double_rejects_java_suffixes(spark):
    texts = ["1.5", "-2e3", " 7 ", "1.5f", "1.5d", "2D", "n/a", "", "inf", "-Inf", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["v"] for r in df.select(fn.parse_double(F.col("t")).alias("v")).collect()]
    assert got == [1.5, -2000.0, 7.0, None, None, None, None, None, float("inf"), float("-inf"), None]


def test_call_and_side_rules_differ_on_a_bare_letter(spark):
    df = spark.createDataFrame([("c",), ("Call",), ("PUT",), ("x",), ("",), (None,)], "t string")
    rows = df.select(fn.is_call(F.col("t")).alias("c"), fn.side(F.col("t")).alias("s")).collect()
    assert [r["c"] for r in rows] == [False, True, False, False, False, None]
    assert [r["s"] for r in rows] == ["call", "call", "put", None, None, None]


def test_weekday_ordinals_count_every_weekday_once(spark):
    days = [date(1969, 12, 20) + timedelta(days=i) for i in range(60)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    rows = df.select(
        "d",
        fn.weekday_ordinal(F.col("d")).alias("n"),
        fn.weekday_from_ordinal(fn.weekday_ordinal(F.col("d"))).alias("back"),
    ).collect()
    for before, after in zip(rows, rows[1:]):
        assert after["n"] - before["n"] == (1 if after["d"].weekday() < 5 else 0)
    for r in rows:
        if r["d"].weekday() < 5:
            assert r["back"] == r["d"]
        else:
            assert r["back"] == r["d"] - timedelta(days=r["d"].weekday() - 4)


def test_upper_median(spark):
    def median(*values):
        return one(spark, fn.upper_median(F.array(*[F.lit(v) for v in values])))

    assert median(1) == 1
    assert median(3, 1) == 3
    assert median(5, 1, 3) == 3
    assert median(9, 1, 5, 3) == 5
    assert one(spark, fn.upper_median(F.array().cast("array<bigint>"))) is None


def test_percent_and_text(spark):
    assert one(spark, fn.percent(F.lit(1), F.lit(0))) is None
    assert one(spark, fn.percent(F.lit(1), F.lit(20))) == 5.0
    # Half to even on the exact value: 0.25 is exact, 0.35 is just below.
    assert one(spark, fn.one_decimal(F.lit(0.25))) == "0.2"
    assert one(spark, fn.one_decimal(F.lit(0.35))) == "0.3"


def test_unknown_dataset():
    import pytest

    with pytest.raises(ValueError):
        dataset("bonds")
