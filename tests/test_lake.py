from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strikelake.operators import merge
from strikelake.schemas import ENVELOPE_SCHEMA, OPTION_KEYS, OPTIONS, OPTIONS_SCHEMA, dataset
from strikelake.sources import symbol_files
from strikelake.sources.lake import Lake, purge_rows
from strikelake.streaming.ingest import ingest_stream, read_landing, write_batch
from tests.conftest import PRICE, QUOTE, bar, d, quote

KEYS = ("underlying_symbol", *OPTION_KEYS)


def quotes(spark, rows):
    return spark.createDataFrame(rows, QUOTE)


def prices(spark, rows):
    return spark.createDataFrame(rows, PRICE)


def test_keep_last_keeps_the_content_of_the_last_row(spark):
    rng = random.Random(3)
    rows = [
        quote(rng.choice("AB"), "2024-01-10", rng.choice([1.0, 2.0, None]), rng.choice(["call", None]), seq=i, bid=float(i))
        for i in range(200)
    ]
    expected = {}
    for r in rows:
        expected[(r[0], r[3], r[4])] = r[6]
    got = merge.keep_last(quotes(spark, rows).repartition(4), KEYS, ["seq"]).collect()
    assert {(r["underlying_symbol"], r["strike"], r["option_type"]): r["bid"] for r in got} == expected
    assert len(got) == len(expected)


def test_keep_last_uses_the_keys_that_exist(spark):
    df = quotes(spark, [quote(strike=1.0, seq=1), quote(strike=2.0, seq=2)])
    assert merge.keep_last(df.drop("strike"), KEYS, ["seq"]).count() == 1
    assert merge.keep_last(df.select("bid"), KEYS, ["bid"]).count() == 2


def test_keep_last_cuts_copies_before_the_shuffle(spark):
    df = merge.keep_last(quotes(spark, [quote()]), KEYS, ["seq"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Exchange hashpartitioning")
    assert "WindowGroupLimit" in above and "Partial" in below


def test_union_brings_both_sides_to_the_fixed_types(spark):
    a = quotes(spark, [quote()]).drop("ask")
    b = spark.createDataFrame(
        [("SPY", "2024-01-11", "x", "5.5", 7, "n")],
        "underlying_symbol string, quote_date string, expiration string, strike string, bid int, extra string",
    )
    out = merge.union_chunks([a, b])
    kinds = {f.name: f.dataType for f in OPTIONS_SCHEMA}
    assert all(f.dataType == kinds[f.name] for f in out.schema if f.name in kinds)
    second = out.filter(F.col(merge.STORED_FIRST) == 1).first()
    assert second["quote_date"] == d("2024-01-11") and second["expiration"] is None
    assert (second["strike"], second["bid"], second["extra"], second["option_type"]) == (5.5, 7.0, "n", None)


def test_union_of_clashing_unknown_columns(spark):
    def frame(value, kind):
        return spark.createDataFrame([("SPY", value)], f"underlying_symbol string, extra {kind}")

    assert merge.union_chunks([frame(1, "int"), frame(2, "bigint")]).schema["extra"].dataType.simpleString() == "bigint"
    mixed = merge.union_chunks([frame(1, "int"), frame("b", "string")])
    assert {r["extra"] for r in mixed.collect()} == {"1", "b"}
    with pytest.raises(ValueError):
        merge.union_chunks([])


def test_empty_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert lake.scan("options").schema.names == OPTIONS_SCHEMA.names
    assert lake.scan("options").count() == 0 and lake.symbols("prices").count() == 0
    assert lake.status().count() == 0
    with pytest.raises(ValueError):
        lake.scan("bonds")


def stored(lake, *columns):
    return {tuple(r) for r in lake.scan("options").select("underlying_symbol", "quote_date", "strike", *columns).collect()}


def test_upsert_merges_and_keeps_other_parts(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    first = [quote("spy", "2024-01-10", 1.0, bid=1.0), quote("SPY", "2024-02-10", 2.0), quote("QQQ", "2024-01-10", 3.0)]
    first += [quote("SPY", None, 4.0), quote("007", "2024-01-10", 5.0), quote("bad symbol"), quote(None)]
    lake.upsert_options(quotes(spark, first), ["seq"])
    second = [quote("SPY", "2024-01-10", 1.0, seq=s, bid=b) for s, b in ((1, 9.0), (3, 7.0), (2, 8.0))]
    second += [quote("SPY", "2024-01-11", 1.0, bid=5.0)]
    lake.upsert_options(quotes(spark, second), ["seq"])
    assert stored(lake, "bid") == {
        ("SPY", d("2024-01-10"), 1.0, 7.0),
        ("SPY", d("2024-01-11"), 1.0, 5.0),
        ("SPY", d("2024-02-10"), 2.0, 1.0),
        ("SPY", None, 4.0, 1.0),
        ("QQQ", d("2024-01-10"), 3.0, 1.0),
        ("007", d("2024-01-10"), 5.0, 1.0),
    }
    versions = {(r["symbol"], r["period"]): r["version"] for r in lake.manifest("options").collect()}
    assert versions == {("SPY", 202401): 2, ("SPY", 202402): 1, ("SPY", 0): 1, ("QQQ", 202401): 1, ("007", 202401): 1}
    assert [r["symbol"] for r in lake.symbols("options").collect()] == ["007", "QQQ", "SPY"]
    status = {r["symbol"]: r for r in lake.status().collect()}
    assert (status["SPY"]["row_count"], status["SPY"]["date_min"], status["SPY"]["date_max"]) == (4, d("2024-01-10"), d("2024-02-10"))
    live = [p for p in lake._paths(OPTIONS, lake.manifest("options"))]
    on_disk = sum(os.path.getsize(os.path.join(p, f)) for p in live for f in os.listdir(p) if f.endswith(".parquet"))
    # Bytes are shared out by rows, so each symbol may be off by rounding.
    assert abs(sum(r["size_bytes"] for r in status.values()) - on_disk) <= len(versions)
    assert {(r["underlying_symbol"], r["reason"]) for r in lake.rejects("options").collect()} == {
        ("bad symbol", "invalid symbol"), (None, "no symbol")
    }


def test_upsert_twice_changes_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    df = quotes(spark, [quote(strike=float(i % 3), seq=i, bid=float(i)) for i in range(9)])
    lake.upsert_options(df, ["seq"])
    before = stored(lake, "bid")
    lake.upsert_options(df, ["seq"])
    assert stored(lake, "bid") == before and len(before) == 3


def test_scan_prunes_directories(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    rows = [quote(s, f"2024-{m:02}-15") for s in ("A", "B", "C") for m in range(1, 7)]
    lake.upsert_options(quotes(spark, rows), ["seq"])
    df = lake.scan("options", ["b"], "2024-02-01", "2024-03-20")
    assert {(r["underlying_symbol"], r["quote_date"].month) for r in df.collect()} == {("B", 2), ("B", 3)}
    assert len(df.inputFiles()) == 2  # the parts of two months that hold the symbol
    assert all(f"period=2024{m}" in f for f, m in zip(sorted(df.inputFiles()), ("02", "03"), strict=True))


def test_scan_moves_no_rows_to_find_the_live_ones(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    for month in (1, 2, 2):
        lake.upsert_options(quotes(spark, [quote(s, f"2024-{month:02}-15") for s in "ABC"]), ["seq"])
    # Two loads of the same days meet in February: until they are folded, keys decide.
    assert lake.compact("options") >= 1 and lake.compact("options") == 0
    lake.upsert_options(quotes(spark, [quote(s, "2024-02-16") for s in "ABC"]), ["seq"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lake.scan("options")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "Join" not in plan
    assert lake.scan("options").count() == 9


def files_of(lake, name, version):
    base = lake._dir(dataset(name), "data", f"version={version}")
    return [os.path.join(d, f) for d, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")]


def test_lookup_opens_the_files_that_may_match(spark, tmp_path):
    lake = Lake(spark, str(tmp_path), part="year")
    for k, strikes in enumerate(([1.0, 2.0], [50.0, 60.0], [2.0, 55.0])):
        rows = [quote("A", f"2024-01-{10 + i:02}", strike=s, bid=float(10 * k + i)) for i, s in enumerate(strikes)]
        lake.upsert_options(quotes(spark, [*rows, quote("A", "2024-02-01", strike=None, bid=0.0), quote("B", "2024-01-10", strike=1.0)]), ["seq"])

    def found(**ranges):
        rows = lake.lookup("options", "a", **ranges)
        return {(str(r["quote_date"]), r["strike"], r["bid"]) for r in rows.collect()}, len(rows.inputFiles())

    assert found(strike=(1.0, 1.5)) == ({("2024-01-10", 1.0, 0.0)}, 1)
    assert found(strike=(None, 10.0))[0] == {("2024-01-10", 1.0, 0.0), ("2024-01-11", 2.0, 1.0), ("2024-01-10", 2.0, 20.0)}
    assert found(strike=(51.0, None), quote_date=("2024-01-11", "2024-01-11"))[0] == {("2024-01-11", 60.0, 11.0), ("2024-01-11", 55.0, 21.0)}
    assert found(strike=(100.0, None)) == (set(), 0) and found(expiration=("2025-01-01", None)) == (set(), 0)
    # A key stored again counts once, in its newest form.
    lake.upsert_options(quotes(spark, [quote("A", "2024-01-10", strike=1.0, bid=99.0)]), ["seq"])
    assert found(strike=(1.0, 1.5)) == ({("2024-01-10", 1.0, 99.0)}, 2)
    lake.compact("options")
    assert found(strike=(1.0, 1.5))[0] == {("2024-01-10", 1.0, 99.0)}
    lake.write_prices(prices(spark, [bar("A", "2024-01-01"), bar("A", "2024-01-02")]))
    assert lake.lookup("prices", "A", date=("2024-01-02", None)).count() == 1
    with pytest.raises(ValueError):
        lake.lookup("options", "A", bid=(1, 2))


def test_a_load_costs_nothing_of_the_history(spark, tmp_path):
    """Bytes of a one-day load do not depend on what is stored, and the stored rows are not even read."""
    sizes = []
    for years in (1, 12):
        lake = Lake(spark, str(tmp_path / str(years)))
        history = [bar(s, f"{2000 + y}-{m:02}-10", float(y)) for s in ("A", "B") for y in range(years) for m in range(1, 13)]
        lake.write_prices(prices(spark, history))
        for path in files_of(lake, "prices", 1):
            os.chmod(path, 0)
            os.rename(path, path + ".away")
        lake.write_prices(prices(spark, [bar("A", "2024-03-01", 1.0), bar("B", "2024-03-01", 2.0)]))
        sizes.append(sum(os.path.getsize(f) for f in files_of(lake, "prices", 2)))
        for path in (x + ".away" for x in files_of(lake, "prices", 2)):
            assert not os.path.exists(path)
    assert sizes[0] == sizes[1] > 0


def test_loads_beside_one_another_and_folded(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    draw, want = random.Random(8), {}
    for load in range(4):
        rows = [bar(draw.choice("AB"), f"2024-01-{draw.randint(1, 20):02}", float(load * 100 + i)) for i in range(15)]
        lake.write_prices(prices(spark, rows).coalesce(1))
        for r in rows:
            want[r[0], str(r[1])] = r[5]
    assert closes(lake) == want
    status = {r["symbol"]: (r["row_count"], str(r["date_min"]), str(r["date_max"])) for r in lake.status().collect()}
    days = {x: sorted(day for symbol, day in want if symbol == x) for x in "AB"}
    assert status == {x: (len(d), d[0], d[-1]) for x, d in days.items()}
    assert lake.compact("prices") == len({r["bucket"] for r in lake.manifest("prices").collect()})
    assert closes(lake) == want
    assert {r["row_count"] for r in lake.manifest("prices").collect()} == {len(d) for d in days.values()}
    assert {r["symbol"]: r["row_count"] for r in lake.status().collect()} == {x: len(d) for x, d in days.items()}
    assert lake.expire("prices") > 0 and closes(lake) == want


def test_a_crowded_dataset_is_folded_by_its_loads(spark, tmp_path):
    lake = Lake(spark, str(tmp_path), fold_after=3)
    for i in range(6):
        lake.write_prices(prices(spark, [bar("A", "2024-01-10", float(i)), bar("A", f"2024-01-{11 + i}", 1.0)]))
    assert len({r["version"] for r in lake.manifest("prices").collect()}) <= 3
    assert len(closes(lake)) == 7 and closes(lake)["A", "2024-01-10"] == 5.0


class Interleaved:
    """Lets another writer commit between the work of a writer and its own commit."""

    def __init__(self, lake, others):
        self.lake, self.commit, self.others = lake, lake._commit, list(others)
        lake._commit = self

    def __call__(self, *args, **kwargs):
        if self.others:
            self.others.pop(0)()
        return self.commit(*args, **kwargs)


def test_two_loads_at_once_are_both_stored(spark, tmp_path):
    first, second = Lake(spark, str(tmp_path)), Lake(spark, str(tmp_path))
    first.write_prices(prices(spark, [bar("A", "2024-01-01", 1.0)]))
    Interleaved(first, [lambda: second.write_prices(prices(spark, [bar("A", "2024-01-02", 2.0), bar("A", "2024-01-03", 2.0)]))])
    first.write_prices(prices(spark, [bar("A", "2024-01-03", 3.0), bar("B", "2024-01-01", 4.0)]))
    # The later commit is the newer load.
    assert closes(second) == {
        ("A", "2024-01-01"): 1.0, ("A", "2024-01-02"): 2.0, ("A", "2024-01-03"): 3.0, ("B", "2024-01-01"): 4.0
    }
    assert first.snapshots("prices") == [1, 2, 3]


def test_first_loads_at_once_are_both_stored(spark, tmp_path):
    first, second = Lake(spark, str(tmp_path)), Lake(spark, str(tmp_path))
    Interleaved(first, [lambda: second.upsert_options(quotes(spark, [quote("B", bid=2.0)]), ["seq"])])
    first.upsert_options(quotes(spark, [quote("A", bid=1.0)]), ["seq"])
    assert {x[0] for x in stored(first)} == {"A", "B"}


@pytest.mark.parametrize("rewrite", ["compact", "purge", "overwrite"])
def test_a_rewrite_keeps_the_load_that_came_meanwhile(spark, tmp_path, rewrite):
    first, second = Lake(spark, str(tmp_path)), Lake(spark, str(tmp_path))
    first.write_prices(prices(spark, [bar("A", "2024-01-01", 1.0), bar("B", "2024-01-01", 1.0)]))
    first.write_prices(prices(spark, [bar("A", "2024-01-01", 2.0)]))
    Interleaved(first, [lambda: second.write_prices(prices(spark, [bar("A", "2024-01-01", 3.0), bar("A", "2024-01-02", 3.0)]))])
    new = {("A", "2024-01-01"): 3.0, ("A", "2024-01-02"): 3.0}
    if rewrite == "compact":
        first.compact("prices")
        want = {**new, ("B", "2024-01-01"): 1.0}
    elif rewrite == "purge":
        first.purge(spark.createDataFrame([("B", "prices")], "symbol string, dataset string"))
        want = new
    else:
        first.write_prices(prices(spark, [bar("A", "2024-01-05", 9.0)]), mode="overwrite")
        want = {**new, ("A", "2024-01-05"): 9.0, ("B", "2024-01-01"): 1.0}
    assert closes(second) == want
    second.compact("prices")
    assert closes(second) == want


def test_two_rewrites_of_a_part_at_once(spark, tmp_path):
    first, second = Lake(spark, str(tmp_path)), Lake(spark, str(tmp_path))
    first.write_prices(prices(spark, [bar(s, "2024-01-01", 1.0) for s in "ABCDEFGH"]))
    request = lambda s: spark.createDataFrame([(s, "prices")], "symbol string, dataset string")
    Interleaved(first, [lambda s=s: second.purge(request(s)) for s in "BCDEFG"])
    first.purge(request("A"))
    # What was purged meanwhile in a part that the other rewrites does not come back.
    assert not {s for s, _ in closes(first)} & {"A", "B"}
    assert ("H", "2024-01-01") in closes(first)


def test_a_batch_is_stored_once(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    load = lambda level, number: lake.write_prices(prices(spark, [bar("A", level=level)]), batch=("q", number))
    load(1.0, 0)
    load(2.0, 0)
    assert lake.snapshots("prices") == [1] and set(closes(lake).values()) == {1.0}
    lake.write_prices(prices(spark, [bar("not a symbol")]), batch=("q", 1))
    load(3.0, 1)
    assert set(closes(lake).values()) == {1.0} and lake.state("prices").batches == {"q": 1}
    lake.write_prices(prices(spark, [bar("A", level=4.0)]), batch=("other", 0))
    assert set(closes(lake).values()) == {4.0} and lake.state("prices").batches == {"q": 1, "other": 0}
    Interleaved(lake, [lambda: Lake(spark, str(tmp_path)).write_prices(prices(spark, [bar("A", level=5.0)]), batch=("q", 2))])
    load(6.0, 2)
    assert set(closes(lake).values()) == {5.0}


def test_changes_between_snapshots(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert lake.changes("options", 0).count() == 0
    first = quotes(spark, [quote("A", bid=1.0), quote("A", strike=2.0), quote("B", "2024-03-01")]).withColumn("venue", F.lit("x"))
    lake.upsert_options(first, ["seq"])
    same = [quote("A", strike=2.0), quote("A", bid=7.0), quote("A", strike=3.0), quote(None, strike=None)]
    second = quotes(spark, same).withColumn("venue", F.lit("x"))
    lake.upsert_options(second, ["seq"])

    def told(since, until=None):
        found = lake.changes("options", since, until).collect()
        return sorted((r["change"], r["underlying_symbol"], r["strike"], r["bid"]) for r in found)

    assert told(0, 1) == [("inserted", "A", 2.0, 1.0), ("inserted", "A", 100.0, 1.0), ("inserted", "B", 100.0, 1.0)]
    assert told(1, 2) == [("changed", "A", 100.0, 7.0), ("inserted", "A", 3.0, 1.0)]
    lake.compact("options")
    assert told(2, 3) == [] and told(1) == told(1, 2)
    lake.purge(spark.createDataFrame([("B", "options")], "symbol string, dataset string"))
    assert told(3, 4) == [("removed", "B", 100.0, 1.0)]
    assert len(told(0)) == 3
    # Parts that stayed as they were are not read.
    files = lake.changes("options", 1, 2).inputFiles()
    assert files and all("period=202401" in f for f in files)
    assert lake.scan("options", snapshot=1).count() == 3 and lake.scan("options", snapshot=0).count() == 0
    with pytest.raises(ValueError):
        lake.scan("options", snapshot=9)


def test_columns_the_table_lacks_are_kept(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    first = quotes(spark, [quote("A", bid=1.0), quote("B")]).drop("last").withColumn("venue", F.lit(7))
    lake.upsert_options(first, ["seq"])
    lake.upsert_options(quotes(spark, [quote("A", "2024-01-11")]).drop("last"), ["seq"])
    lake.upsert_options(quotes(spark, [quote("B", "2024-01-11")]), ["seq"])
    got = {(r["underlying_symbol"], str(r["quote_date"])): r["extras"] for r in lake.scan("options").collect()}
    assert got == {
        ("A", "2024-01-10"): {"venue": "7"}, ("B", "2024-01-10"): {"venue": "7"},
        ("A", "2024-01-11"): None, ("B", "2024-01-11"): None,
    }
    missing = {r["symbol"]: r["missing"] for r in lake.missing_columns("options").collect()}
    assert "last" in missing["A"] and "last" not in missing["B"] and "bid" not in missing["A"]
    assert "gamma" in missing["B"]


def test_a_key_of_extras_becomes_a_column(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    load = lambda rows, **more: lake.upsert_options(quotes(spark, rows).withColumns({k: F.lit(v) for k, v in more.items()}), ["seq"])
    load([quote("A"), quote("B")], lot="7", venue="x")
    load([quote("C")], lot="no number")
    assert "lot" not in lake.scan("options").columns
    lake.promote("options", "lot", "int")
    lake.promote("options", "lot", "int")
    load([quote("D")], lot=8, venue="y")
    load([quote("A", bid=5.0)])
    got = {r["underlying_symbol"]: (r["lot"], r["extras"]) for r in lake.scan("options").collect()}
    assert got == {"A": (None, None), "B": (7, {"venue": "x"}), "C": (None, None), "D": (8, {"venue": "y"})}
    # Snapshots from before have it where it was; a wider type reads what a narrower one stored.
    assert lake.scan("options", snapshot=2).columns == OPTIONS_SCHEMA.names
    lake.promote("options", "lot", "bigint")
    load([quote("E")], lot=2**40)
    lots = lambda: {r["underlying_symbol"]: r["lot"] for r in lake.scan("options").collect()}
    want = {"A": None, "B": 7, "C": None, "D": 8, "E": 2**40}
    assert lots() == want
    lake.compact("options")
    assert lots() == want
    told = lake.changes("options", 3).filter("change = 'inserted'").collect()
    assert {(r["underlying_symbol"], r["lot"]) for r in told} == {("D", 8), ("E", 2**40)}
    lake.purge(spark.createDataFrame([("E", "options")], "symbol string, dataset string"))
    assert lots() == {k: v for k, v in want.items() if k != "E"}
    for column, kind in (("lot", "int"), ("strike", "double"), ("other", "array<int>")):
        with pytest.raises(ValueError):
            lake.promote("options", column, kind)
    with pytest.raises(ValueError):
        lake.promote("prices", "lot", "int")


def test_rows_that_the_order_does_not_tell_apart(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.upsert_options(quotes(spark, [quote(seq=None, bid=float(i)) for i in range(3)]), ["seq"])
    assert [r["bid"] for r in lake.scan("options").collect()] == [2.0]
    lake.write_prices(prices(spark, [bar("SPY", level=9.0), bar("SPY", level=1.0)]).coalesce(1))
    assert closes(lake) == {("SPY", "2024-01-10"): 1.0}


def test_parts_by_year(spark, tmp_path):
    lake = Lake(spark, str(tmp_path), part="year")
    lake.upsert_options(quotes(spark, [quote("A", x, bid=1.0) for x in ("2023-05-01", "2024-01-10", "2024-06-10")]), ["seq"])
    lake.upsert_options(quotes(spark, [quote("A", "2024-06-10", bid=2.0)]), ["seq"])
    versions = {(r["symbol"], r["period"]): r["version"] for r in lake.manifest("options").collect()}
    assert versions == {("A", 202300): 1, ("A", 202400): 2}
    got = lake.scan("options", date_from="2024-02-01", date_to="2024-06-10").collect()
    assert [(str(r["quote_date"]), r["bid"]) for r in got] == [("2024-06-10", 2.0)]
    assert lake.scan("options").count() == 3
    with pytest.raises(ValueError, match="by year"):
        Lake(spark, str(tmp_path))


def test_a_failed_write_leaves_the_state_as_it_was(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.upsert_options(quotes(spark, [quote(bid=1.0)]), ["seq"])
    broken = quotes(spark, [quote(bid=2.0)]).withColumn("ask", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        lake.upsert_options(broken, ["seq"])
    assert stored(lake, "bid") == {("SPY", d("2024-01-10"), 100.0, 1.0)}
    lake.upsert_options(quotes(spark, [quote(bid=3.0)]), ["seq"])
    assert stored(lake, "bid") == {("SPY", d("2024-01-10"), 100.0, 3.0)}


def test_unreadable_stored_data_is_not_passed_over(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.upsert_options(quotes(spark, [quote(bid=1.0)]), ["seq"])
    for path, _, files in os.walk(tmp_path / "options" / "by_month_16" / "data"):
        for f in files:
            if f.endswith(".parquet"):
                with open(os.path.join(path, f), "wb") as h:
                    h.write(b"damaged")
            elif f.endswith(".crc"):
                os.remove(os.path.join(path, f))
    lake.upsert_options(quotes(spark, [quote(bid=2.0)]), ["seq"])
    # The load stands beside it; whoever needs the damaged rows fails.
    for read in (lambda: lake.scan("options").count(), lambda: lake.compact("options"), lambda: lake.status().collect()):
        with pytest.raises(Exception):
            read()
    assert sorted(r["version"] for r in lake.manifest("options").collect()) == [1, 2]
    assert lake.snapshots("options") == [1, 2]


def closes(lake):
    return {(r["symbol"], str(r["date"])): r["close"] for r in lake.scan("prices").collect()}


def test_prices_merge_and_overwrite(spark, tmp_path):
    first = [bar("SPY", "2024-01-10", 1.0), bar("SPY", "2024-01-11", 2.0), bar("QQQ", "2024-01-10", 3.0)]
    second = [bar("SPY", "2024-01-11", 5.0), bar("SPY", "2024-01-12", 6.0)]
    merged, replaced = Lake(spark, str(tmp_path / "m")), Lake(spark, str(tmp_path / "o"))
    for rows in (first, second):
        merged.write_prices(prices(spark, rows))
        replaced.write_prices(prices(spark, rows), mode="overwrite")
    new = {("SPY", "2024-01-11"): 5.0, ("SPY", "2024-01-12"): 6.0, ("QQQ", "2024-01-10"): 3.0}
    assert closes(merged) == {**new, ("SPY", "2024-01-10"): 1.0}
    assert closes(replaced) == new
    with pytest.raises(ValueError):
        merged.write_prices(prices(spark, first), mode="append")


def test_purge_and_expire(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.upsert_options(quotes(spark, [quote("SPY"), quote("QQQ")]), ["seq"])
    lake.write_prices(prices(spark, [bar("SPY"), bar("QQQ")]))
    requests = spark.createDataFrame(
        [("spy", "options"), ("QQQ", "prices"), ("IWM", "options")], "symbol string, dataset string"
    )
    got = {(r["symbol"], r["dataset"]): (r["rows_removed"], r["warning"]) for r in lake.purge(requests).collect()}
    assert got == {
        ("SPY", "options"): (1, None),
        ("QQQ", "prices"): (1, None),
        ("IWM", "options"): (0, "nothing stored under this symbol"),
    }
    assert [r["symbol"] for r in lake.symbols("options").collect()] == ["QQQ"]
    assert [r["symbol"] for r in lake.symbols("prices").collect()] == ["SPY"]
    assert {r["underlying_symbol"] for r in lake.scan("options").collect()} == {"QQQ"}
    dead = tmp_path / "options" / "by_month_16" / "data" / "version=1"
    before = len(list(dead.glob("bucket=*/period=*")))
    assert lake.expire("options") >= 1 and len(list(dead.glob("bucket=*/period=*"))) < before
    assert lake.expire("options") == 0
    assert {r["underlying_symbol"] for r in lake.scan("options").collect()} == {"QQQ"}
    lake.purge(spark.createDataFrame([("QQQ", "options")], "symbol string, dataset string"))
    assert lake.scan("options").count() == 0
    lake.upsert_options(quotes(spark, [quote("SPY", bid=4.0)]), ["seq"])
    assert stored(lake, "bid") == {("SPY", d("2024-01-10"), 100.0, 4.0)}


def test_purge_rows(spark):
    requests = spark.createDataFrame([("spy", "prices"), ("QQQ", "options")], "symbol string, dataset string")
    left = purge_rows(prices(spark, [bar("SPY"), bar("QQQ")]), requests, "prices")
    assert [r["symbol"] for r in left.collect()] == ["QQQ"]


def test_foreign_symbol_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    assert symbol_files.read_symbol_files(spark, str(tmp_path), "prices").count() == 0
    folder = tmp_path / "prices"
    folder.mkdir()
    days = pa.array([d("2024-01-01"), d("2024-01-02")])
    level, volume = pa.array([1.0, 2.0]), pa.array([1, 2], pa.uint64())
    pq.write_table(pa.table({"date": days, "close": level, "volume": volume}), folder / "SPY.parquet")
    pq.write_table(pa.table({"date": days, "close": level, "open": level, "volume": volume}), folder / "QQQ.parquet")
    df = symbol_files.read_symbol_files(spark, str(tmp_path), "prices")
    assert df.schema["volume"].dataType.simpleString() == "bigint"
    assert {(r["symbol"], r["volume"], r["open"]) for r in df.collect()} == {
        ("SPY", 1, None), ("SPY", 2, None), ("QQQ", 1, 1.0), ("QQQ", 2, 2.0)
    }
    (folder / "BAD.parquet").write_bytes(b"not parquet at all")
    status = symbol_files.symbol_file_status(spark, str(tmp_path), "prices").collect()
    got = {r["symbol"]: (r["size_bytes"], r["row_count"], r["date_min"], r["date_max"]) for r in status}
    assert got["BAD"] == (18, 0, None, None)
    problems = {r["symbol"]: r["problem"] for r in status}
    assert "not a Parquet file" in problems["BAD"] and problems["SPY"] is None
    assert got["SPY"] == (os.path.getsize(folder / "SPY.parquet"), 2, d("2024-01-01"), d("2024-01-02"))
    pq.write_table(pa.table({"quote_date": ["2024-01-03"], "close": ["3.5"]}), folder / "TXT.parquet")
    pq.write_table(pa.table({"close": [4.0]}), folder / "NODATE.parquet")
    mixed = {(r["symbol"], r["date"], r["close"]) for r in symbol_files.read_symbol_files(spark, str(tmp_path), "prices").collect()}
    assert {x for x in mixed if x[0] in ("TXT", "NODATE")} == {("TXT", d("2024-01-03"), 3.5), ("NODATE", None, 4.0)}
    assert len(mixed) == 6
    (folder / "TXT.parquet").unlink()
    (folder / "NODATE.parquet").unlink()
    listed = symbol_files.list_symbol_files(spark, str(tmp_path), "prices")
    assert sorted(r["symbol"] for r in listed.collect()) == ["BAD", "QQQ", "SPY"]


def test_a_file_damaged_further_in_is_not_shortened(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "prices"
    folder.mkdir()
    n = 40_000
    table = pa.table({"date": pa.array([d("2024-01-01")] * n), "close": pa.array([float(i * 7919 % n) for i in range(n)])})
    pq.write_table(table, folder / "SPY.parquet", row_group_size=5000, compression="none", use_dictionary=False)
    pq.write_table(table.slice(0, 10), folder / "QQQ.parquet")
    footer = pq.ParquetFile(folder / "SPY.parquet").metadata
    at = footer.row_group(6).column(1).data_page_offset
    data = bytearray((folder / "SPY.parquet").read_bytes())
    data[at : at + 40] = b"\xff" * 40
    (folder / "SPY.parquet").write_bytes(bytes(data))
    status = {r["symbol"]: r["row_count"] for r in symbol_files.symbol_file_status(spark, str(tmp_path), "prices").collect()}
    assert status == {"SPY": n, "QQQ": 10}
    with pytest.raises(Exception):
        symbol_files.read_symbol_files(spark, str(tmp_path), "prices").agg(F.sum("close")).collect()


def test_each_symbol_file_is_read_once(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "prices"
    folder.mkdir()
    for k, days in enumerate(([d("2024-01-01"), d("2024-01-05")], ["2024-02-01", "2024-02-03"], ["01 March 2024", None], [None, None])):
        pq.write_table(pa.table({"date": days if k else pa.array(days), "close": [1.0, 2.0]}), folder / f"S{k}.parquet")
    plan = symbol_files.read_symbol_files(spark, str(tmp_path), "prices")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len({f.schema for f in symbol_files.footers(spark, str(tmp_path), "prices")})
    status = symbol_files.symbol_file_status(spark, str(tmp_path), "prices")
    got = {r["symbol"]: (r["row_count"], r["date_min"], r["date_max"]) for r in status.collect()}
    assert got["S0"] == (2, d("2024-01-01"), d("2024-01-05")) and got["S1"] == (2, d("2024-02-01"), d("2024-02-03"))
    assert got["S3"] == (2, None, None) and got["S2"][0] == 2
    (folder / "S2.parquet").unlink()
    (folder / "S3.parquet").unlink()
    # All footers tell their dates: no file is scanned.
    told = symbol_files.symbol_file_status(spark, str(tmp_path), "prices")
    assert "FileScan" not in told._jdf.queryExecution().executedPlan().toString()


def land(folder, name, *pages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(p) for p in pages))


def options_page(seq, bid, strike="1"):
    names = ["underlying_symbol", "type", "exp_date", "tradetime", "strike", "bid"]
    row = ["SPY", "Call", "2024-03-15", "2024-01-15", strike, bid]
    return {"dataset": "options", "symbol": "SPY", "page_seq": seq, "meta": {"fields": names}, "data": [row]}


def test_stream_ingest(spark, tmp_path):
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    lake = Lake(spark, str(tmp_path / "lake"))
    bars = {"timestamp": 1704067200, "open": 1.0, "high": 1.0, "low": 1.0, "close": 2.5, "adjclose": 1.0, "volume": 7}
    price_page = {"dataset": "prices", "symbol": "SPY", "page_seq": 3, "data": [bars, {**bars, "timestamp": -(2**63)}]}
    land(landing, "a.json", options_page(2, "2.0"), options_page(1, "1.0"), options_page(1, "5.0", "9"), price_page)

    def run():
        ingest_stream(read_landing(spark, str(landing)), lake, checkpoint).awaitTermination()

    run()
    bids = {r["strike"]: (r["bid"], r["option_type"]) for r in lake.scan("options").collect()}
    assert bids == {1.0: (2.0, "call"), 9.0: (5.0, "call")}
    assert closes(lake) == {("SPY", "2024-01-01"): 2.5}
    # A late delivery of an old sequence number still replaces what was stored before it.
    land(landing, "b.json", options_page(0, "7.0"))
    run()
    run()
    assert {r["strike"]: r["bid"] for r in lake.scan("options").collect()} == {1.0: 7.0, 9.0: 5.0}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    bars = {"timestamp": 1704067200, "open": 1.0, "high": 1.0, "low": 1.0, "close": 2.5, "adjclose": 1.0, "volume": 7}
    page = {"dataset": "prices", "symbol": "SPY", "page_seq": 3, "data": [bars]}
    land(tmp_path / "landing", "a.json", options_page(2, "2.0"), page)
    pages = spark.read.schema(ENVELOPE_SCHEMA).json(str(tmp_path / "landing"))
    write = write_batch(lake, "stream")
    write(pages, 4)
    write(pages, 4)
    assert lake.snapshots("options") == [1] and lake.snapshots("prices") == [1]
    # A failure between the two datasets: the replay stores only what is missing.
    half = Lake(spark, str(tmp_path / "half"))
    half.write_prices(prices(spark, [bar("SPY", "2024-01-01", 9.0)]), batch=("stream", 4))
    write_batch(half, "stream")(pages, 4)
    assert half.snapshots("options") == [1] and half.snapshots("prices") == [1]
    assert closes(half) == {("SPY", "2024-01-01"): 9.0}
    write(pages, 5)
    assert lake.snapshots("options") == [1, 2]
    assert not list((tmp_path / "lake" / "staging").iterdir())


def test_a_hot_part_is_written_as_several_files(spark, tmp_path):
    """Most rows in one symbol and month: the write spreads them over tasks by size."""
    lake = Lake(spark, str(tmp_path), slice_rows=10_000)
    hot = spark.range(60000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("S"), F.col("id") % 50)).otherwise("HOT").alias("underlying_symbol"),
        F.lit(d("2024-01-10")).alias("quote_date"),
        F.lit(d("2024-02-16")).alias("expiration"),
        F.col("id").cast("double").alias("strike"),
        F.lit("call").alias("option_type"),
        F.rand(1).alias("bid"),
        F.rand(2).alias("ask"),
        F.rand(3).alias("last"),
        F.col("id").alias("seq"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lake.upsert_options(hot, ["seq"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = {r["symbol"]: (r["n_files"], r["row_count"]) for r in lake.manifest("options").collect()}
    assert files["HOT"][0] > 1 and files["HOT"][1] == 54000
    assert sum(rows for _, rows in files.values()) == 60000


def test_a_load_without_valid_rows_changes_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.upsert_options(quotes(spark, [quote("no symbol")]), ["seq"])
    assert lake.scan("options").count() == 0 and lake.symbols("options").count() == 0
    lake.upsert_options(quotes(spark, [quote("SPY", bid=1.0)]), ["seq"])
    lake.upsert_options(quotes(spark, [quote("")]), ["seq"])
    assert stored(lake, "bid") == {("SPY", d("2024-01-10"), 100.0, 1.0)}
    lake.write_prices(prices(spark, []), mode="overwrite")
    assert lake.scan("prices").count() == 0
