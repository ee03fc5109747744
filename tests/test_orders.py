"""As-of lookup by one sort and order statistics from counts, against their plain definitions."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from strikelake.operators import asof, ranks
from tests.conftest import d


def test_next_date_of_many_candidates(spark):
    draw = random.Random(6)
    start = d("2023-11-20")
    calendar = [(draw.choice("ABC"), start + timedelta(days=draw.randrange(0, 400))) for _ in range(60)]
    calendar += [(None, start), ("A", None), *calendar[:5]]
    rows = [(draw.choice(["A", "A", "A", "B", "C", "D", None]), draw.choice([None, *(start + timedelta(days=k) for k in range(-40, 460, 3))]), i) for i in range(400)]
    rows += rows[:7]
    candidates = spark.createDataFrame(rows, "symbol string, day date, `n o` int").withColumn("_date", F.lit("own"))
    dates = spark.createDataFrame(calendar, "symbol string, date date")
    got = asof.next_date(candidates, dates, "day", "found")
    assert got.columns == ["symbol", "day", "n o", "_date", "found"]

    def expected(symbol, day):
        return min((x for s, x in calendar if s == symbol and s and x and day and x >= day), default=None)

    want = sorted(((s, day, i, expected(s, day)) for s, day, i in rows), key=repr)
    assert sorted(((r["symbol"], r["day"], r["n o"], r["found"]) for r in got.collect()), key=repr) == want
    assert asof.next_date(candidates.limit(0), dates, "day", "found").count() == 0
    assert asof.next_date(candidates, dates.limit(0), "day", "found").filter("found IS NOT NULL").count() == 0


def test_no_candidate_meets_more_than_one_date(spark):
    """One hot symbol: the rows that come out of the only join are those that went in."""
    calendar = spark.range(2000).select(F.lit("A").alias("symbol"), F.date_add(F.lit(d("2020-01-01")), F.col("id").cast("int")).alias("date"))
    candidates = spark.range(5000).select(F.lit("A").alias("symbol"), F.date_add(F.lit(d("2020-01-01")), (F.col("id") % 1990).cast("int")).alias("day"))
    found = asof.next_date(candidates, calendar, "day", "found")
    assert found.count() == 5000 and found.filter("found <> day").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "_month" in plan


@pytest.mark.parametrize("share", [(0, 1), (1, 10), (1, 2), (2, 3), (9, 10), (1, 1)])
def test_order_statistics(spark, share):
    draw, rows = random.Random(9), []
    values = {g: [draw.randrange(6) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 7), ("d", 500), (None, 10))}
    for g, own in values.items():
        rows += [(g, v) for v in own]
    rows += [("a", None), ("none", None)]
    counts = ranks.frequencies(spark.createDataFrame(rows, "g string, v int"), ["g"], "v")
    got = {r["g"]: (r["n_values"], r["x"]) for r in ranks.order_statistics(counts, ["g"], "v", {"x": share}).collect()}
    part, whole = share
    want = {g: (len(own), sorted(own)[min(len(own) * part // whole, len(own) - 1)]) for g, own in values.items()}
    assert got == want
    with pytest.raises(ValueError):
        ranks.order_statistics(counts, ["g"], "v", {"x": (3, 2)})
