"""The report kept up to date equals the whole report, and reads only what changed."""

from __future__ import annotations

import random

from strikelake.plans.quality import quality_report
from strikelake.plans.quality_state import QualityState, quality_report_incremental
from strikelake.sources.lake import Lake
from tests.conftest import PRICE, QUOTE, bar, quote


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def load(spark, lake, draw, symbols, months, n):
    o, p = [], []
    for i in range(n):
        s, day = draw.choice(symbols), f"2024-{draw.choice(months):02}-{draw.randint(1, 28):02}"
        o.append(quote(s, draw.choice([day, day, None]), draw.choice([1.0, 2.0, None]), draw.choice(["call", "put"]), seq=i, bid=draw.choice([0.0, 1.0]), delta=draw.choice([0.1, 0.9, 1.5, None])))
        p.append(bar(s, day, draw.choice([0.0, 5.0])))
    lake.upsert_options(spark.createDataFrame(o, QUOTE), ["seq"])
    lake.write_prices(spark.createDataFrame(p, PRICE))


def test_refreshed_report_equals_the_whole_report(spark, tmp_path):
    lake, draw = Lake(spark, str(tmp_path), buckets=4), random.Random(2)
    assert quality_report_incremental(lake).count() == 0
    load(spark, lake, draw, "ABCD", [1, 2], 60)

    def same():
        assert rows_of(quality_report_incremental(lake)) == rows_of(quality_report(lake.scan("options"), lake.scan("prices")))

    same()
    load(spark, lake, draw, "AE", [2, 3], 20)
    same()
    lake.purge(spark.createDataFrame([("B", "options"), ("A", "prices")], "symbol string, dataset string"))
    same()
    lake.compact("options")
    same()
    assert QualityState(lake).refresh() == 0
    # What a state was made from has expired: everything is read again.
    load(spark, lake, draw, "C", [1], 5)
    load(spark, lake, draw, "C", [1], 5)
    for name in ("options", "prices"):
        lake.expire(name)
    same()


def test_only_changed_parts_are_read(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    months = [quote("A", f"2024-{m:02}-10", seq=m) for m in range(1, 7)]
    lake.upsert_options(spark.createDataFrame(months, QUOTE), ["seq"])
    state = QualityState(lake)
    assert state.refresh() == 6
    lake.upsert_options(spark.createDataFrame([quote("A", "2024-03-11")], QUOTE), ["seq"])
    parts, new, now = state.stale("options")
    assert [p for _, p in parts] == [202403] and now == 2
    files = lake.part_rows("options", new, now).inputFiles()
    assert files and all("period=202403" in f for f in files)
    assert state.refresh() == 1 and state.refresh() == 0
