"""What keeps loads of any size within disk, shuffles and time."""

from __future__ import annotations

import glob
from datetime import datetime

from pyspark.sql import functions as F

from strikelake.operators.merge import keep_last
from strikelake.plans.quality import symbol_facts
from strikelake.plans.run import load_pages
from strikelake.schemas import ENVELOPE_SCHEMA
from strikelake.sources import envelope, lake as lake_module
from strikelake.sources.lake import Lake
from tests.conftest import QUOTE, quote
from tests.test_ingest import FIELDS, page, records
from tests.test_run import PROVIDERS, options_page, price_page, row
from workload import QUERIES, views

LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_landed_pages_are_packed(spark, tmp_path, monkeypatch):
    """pages that land as files hold the names of their fields in every line."""
    lines = [(i, 7, i % 3, 1, 10.0 + i % 5, 100.0 + i, 0.01, 0.02, "A", "O", datetime(1996, 9, 13)) for i in range(40)]
    spark.createDataFrame(lines, LINEITEM).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "scratch_dir", lambda _, label: f"{tmp_path}/scratch/{label}")
    stored = QUERIES["stream_ingest"](spark, str(tmp_path))
    # Five strikes with two kinds of expiration, from each of two loads.
    assert stored.count() == 20
    landed = glob.glob(f"{tmp_path}/scratch/stream/landing/part-*")
    assert landed and all(f.endswith(".json.gz") for f in landed)


def test_parts_of_a_large_load_are_counted_without_looking_for_copies(spark, tmp_path, monkeypatch):
    """of a load above ``slice_rows`` the newest rows are looked for once, not for the count as well."""
    counted, moved = [], []
    store, keep = Lake._store, lake_module.keep_last

    def noted_store(self, ds, rows, total, version, given=None):
        counted.append(_plan(given))
        store(self, ds, rows, total, version, given)

    def noted_keep(rows, *given):
        moved.append(set(rows.columns))
        return keep(rows, *given)

    monkeypatch.setattr(Lake, "_store", noted_store)
    monkeypatch.setattr(lake_module, "keep_last", noted_keep)
    lake = Lake(spark, str(tmp_path), slice_rows=10)
    rows = [quote(strike=float(i % 20), seq=i, bid=float(i)) for i in range(60)]
    lake.upsert_options(spark.createDataFrame(rows, QUOTE), ["seq"])
    assert {(r["strike"], r["bid"]) for r in lake.scan("options").collect()} == {(float(i), 40.0 + i) for i in range(20)}
    assert counted and "Window" not in counted[0]
    assert "gamma" not in moved[0] and "bucket" not in moved[0] and {"bid", "seq", "strike"} <= moved[0]


def test_the_report_looks_at_pages_once_per_dataset(spark, tmp_path):
    """what was asked for and what is unreadable come from the same pass."""
    made = [
        options_page("SPY", 1, row("SPY", "2024-01-15", "1", "5")),
        ("options", None, 1, (["strike"],), "[[", (None,)),
        ("options", "QQQ", 1, (["strike"],), None, (None,)),
        price_page("SPY", (1704067200, 10.0)),
        ("prices", "SPY", 1, (None,), "[", (None,)),
        ("prices", "SPY", 2, (None,), "[", (None,)),
    ]
    spark.createDataFrame(made, ENVELOPE_SCHEMA).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    report = load_pages(Lake(spark, f"{tmp_path}/lake"), pages, f"{tmp_path}/staging", PROVIDERS)
    got = {(r["category"], r["symbol"]): r["message"] for r in report.collect()}
    assert got["prices", "SPY"] == "2 page(s) are no JSON" and got["options", None] == "1 page(s) are no JSON"
    assert got["options", "SPY"] == "" and len(got) == 4
    assert sum("Relation" in line and "links#" in line for line in _plan(report).splitlines()) == 2


def test_rows_are_dealt_over_all_cores(spark, tmp_path):
    """F3, F8: one small file may hold the rows of very many pages."""
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t")
    dealt = views.spread(spark.read.parquet(f"{tmp_path}/t"))
    assert [r[0] for r in dealt.orderBy("id").collect()] == list(range(1000))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) < 100


def test_only_elements_with_a_bracket_are_parsed(spark):
    """F3, F8: texts that hold an array count as before; full rows, short ones and nulls give the same maps."""
    data = ["[1,2,3]", " [4]", "{}", "x[", 7, [None, "2", "3"], ["1", "2", "3", "4"], [], {"a": [1]}]
    pages = spark.createDataFrame([page(data, FIELDS)], ENVELOPE_SCHEMA)
    expected = [
        {"strike": "1", "bid": "2", "type": "3"},
        {"strike": "4"},
        {"bid": "2", "type": "3"},
        {"strike": "1", "bid": "2", "type": "3"},
        {},
    ]
    assert records(envelope.compact_rows(pages)) == expected
    assert records(envelope.page_rows(pages)) == expected
    assert "contains" in _plan(envelope.compact_rows(pages)).lower()
    standard = spark.createDataFrame([page(['{"a":1}', {"attributes": "x", "b": 2}, {"attributes": {"c": 3}}, "t"])], ENVELOPE_SCHEMA)
    assert records(envelope.standard_rows(standard)) == [{"a": "1"}, {"attributes": "x", "b": "2"}, {"c": "3"}]


def test_days_are_sorted_once_and_without_counts(spark):
    """windows of the report sort symbol, day and what they use; counts of rows are added up beside them."""
    lines = [("A", 1), ("A", 3), ("A", None), (None, 1), (None, 3), ("O", 2)]
    bars = [("A", 1), ("A", 2), ("A", 3), ("A", None), (None, 1), (None, 3), ("P", 9)]
    days = "symbol string, n int"
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("day")
    two = F.lit(2).cast("bigint")
    options = spark.createDataFrame(lines, days).select("symbol", day, two.alias("n_rows"), two.alias("coverage_rows"), F.lit(True).alias("covered"))
    prices = spark.createDataFrame(bars, days).select("symbol", day, two.alias("n_rows"), two.alias("null_date"))
    figures = symbol_facts(options, prices)
    got = {
        r["symbol"]: (r["trading_days"], r["missing_days"], r["_first_missing"], r["price_dates"], r["total_dates"], r["o_n_rows"], r["p_null_date"])
        for r in figures.collect()
    }
    assert got == {
        "A": (3, 1, "2024-01-03", 3, 3, 6, 8),
        None: (2, 2, "2024-01-02, 2024-01-04", 2, 2, 4, 4),
        "O": (0, 0, "", 0, 1, 2, 0),
        "P": (0, 0, "", 1, 0, 0, 2),
    }
    physical = symbol_facts(options, prices)._jdf.queryExecution().executedPlan().toString()
    sorts = [x for x in physical.splitlines() if "Sort [" in x and "day#" in x]
    assert len(sorts) == 1 and "FullOuter" not in physical


def test_only_the_newest_rows_of_a_load_are_staged(spark, tmp_path, monkeypatch):
    """copies of a key are not written first; rows that cannot be stored are all kept, copies too."""
    staged = []
    store = Lake._store

    def noted(self, ds, rows, total, version, given=None):
        staged.append((given.count(), total))
        store(self, ds, rows, total, version, given)

    monkeypatch.setattr(Lake, "_store", noted)
    rows = [quote(strike=float(i % 20), seq=i, bid=float(i)) for i in range(60)]
    load = spark.createDataFrame(rows, QUOTE).withColumns(
        {"venue": F.when(F.col("strike") > 9, F.lit("x")), "desk": F.when(F.col("strike") < 5, F.col("seq"))}
    )
    lost = load.filter("seq < 3").withColumn("underlying_symbol", F.lit(None).cast("string"))
    lake = Lake(spark, str(tmp_path))
    lake.upsert_options(load.unionByName(lost).unionByName(lost), ["seq"])
    assert staged == [(20, 20)]
    assert lake.rejects("options").count() == 6
    got = {r["strike"]: (r["bid"], r["extras"]) for r in lake.scan("options").collect()}
    assert got == {
        float(i): (40.0 + i, {"venue": "x"} if i > 9 else {"desk": str(40 + i)} if i < 5 else None) for i in range(20)
    }
    lake.upsert_options(load.limit(0), ["seq"], batch=("b", 1))
    lake.upsert_options(lost, ["seq"])
    assert lake.scan("options").count() == 20 and len(staged) == 1 and lake.rejects("options").count() == 9


def test_a_hash_leads_the_sort_and_equal_keys_stay_equal(spark):
    """both zeros, both NaN and nulls are one key each."""
    keys = [0.0, -0.0, float("nan"), -float("nan"), None, None, 1.0]
    rows = spark.createDataFrame([(k, "a", i) for i, k in enumerate(keys)], "k double, s string, n int")
    newest = keep_last(rows, ["s", "k", "absent"], ["n"])
    assert sorted(r["n"] for r in newest.collect()) == [1, 3, 5, 6]
    sort = [x for x in newest._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in x][-1]
    assert "Sort [_w" in sort
