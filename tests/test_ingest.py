from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from strikelake.operators.normalize import normalize_quotes
from strikelake.schemas import ENVELOPE_SCHEMA, OPTION_COLUMNS, OPTIONS_SCHEMA, PRICES_SCHEMA
from strikelake.sources import envelope, quotes

FIELDS = ["strike", "bid", "type"]


def page(data, fields=None, seq=0):
    text = data if data is None or isinstance(data, str) else json.dumps(data)
    return ("options", "SPY", seq, (fields,), text, (None,))


def records(rows):
    return [r["record"] for r in rows.orderBy("page_seq", "pos").collect()]


def test_compact_rows(spark):
    data = [["37.25", 1.5, None], ["41.75"], ["1", "2", "call", "surplus"], 5, {"strike": 1}, None, [True, [1], {"a": 1}]]
    pages = spark.createDataFrame([page(data, FIELDS)], ENVELOPE_SCHEMA)
    expected = [
        {"strike": "37.25", "bid": "1.5"},
        {"strike": "41.75"},
        {"strike": "1", "bid": "2", "type": "call"},
        {"strike": "true", "bid": "[1]", "type": '{"a":1}'},
    ]
    assert records(envelope.compact_rows(pages)) == expected
    assert records(envelope.page_rows(pages)) == expected
    assert [r["pos"] for r in envelope.compact_rows(pages).orderBy("pos").collect()] == [0, 1, 2, 6]


def test_repeated_field_name_counts_last(spark):
    pages = spark.createDataFrame([page([["1", "2", "3"], ["1"]], ["a", "b", "a"])], ENVELOPE_SCHEMA)
    assert records(envelope.compact_rows(pages)) == [{"a": "3", "b": "2"}, {}]


def test_standard_rows(spark):
    data = [
        {"attributes": {"strike": "37.25", "bid": None}},
        {"strike": 42, "deep": {"x": [1]}},
        {"attributes": 3, "ok": False},
        {"attributes": None, "a": "b"},
        "text",
        [1],
        None,
    ]
    pages = spark.createDataFrame([page(data), page(data, [], 1)], ENVELOPE_SCHEMA)
    expected = [
        {"strike": "37.25"},
        {"strike": "42", "deep": '{"x":[1]}'},
        {"attributes": "3", "ok": "false"},
        {"a": "b"},
    ]
    assert records(envelope.standard_rows(pages)) == expected * 2
    assert records(envelope.page_rows(pages)) == expected * 2


def test_pages_without_rows(spark):
    empties = [None, "[]", '{"a":1}', '"text"', "7", '[[1,', "null"]
    pages = spark.createDataFrame(
        [page(t, f, i) for i, t in enumerate(empties) for f in (FIELDS, None)], ENVELOPE_SCHEMA
    )
    assert envelope.page_rows(pages).count() == 0
    broken = envelope.unreadable_pages(pages)
    assert {r["page_seq"] for r in broken.collect()} == {5}


def test_one_bad_page_does_not_cost_the_others(spark):
    pages = spark.createDataFrame([page("[[", FIELDS, 0), page([["1"]], FIELDS, 1)], ENVELOPE_SCHEMA)
    assert records(envelope.page_rows(pages)) == [{"strike": "1"}]


def test_read_pages_keeps_data_of_any_shape_as_text(spark, tmp_path):
    lines = [
        {"dataset": "options", "page_seq": 1, "meta": {"fields": ["strike"]}, "data": [["1"], ["2"]], "links": {"next": "u"}},
        {"dataset": "options", "page_seq": 2, "meta": {}, "data": [{"strike": "3"}], "links": None},
        {"dataset": "options", "page_seq": 3, "data": None},
    ]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in lines))
    pages = envelope.read_pages(spark, str(tmp_path))
    assert records(envelope.page_rows(pages)) == [{"strike": "1"}, {"strike": "2"}, {"strike": "3"}]


def test_symbol_universe(spark):
    texts = ['["SPY","QQQ"]', "[]", None, '["A", 1]', '{"a":"b"}', '["A", null]', "[1]"]
    pages = spark.createDataFrame([page(t, None, i) for i, t in enumerate(texts)], ENVELOPE_SCHEMA)
    got = envelope.symbol_universe(pages.drop("symbol")).orderBy("page_seq", "symbol").collect()
    assert [(r["page_seq"], r["symbol"]) for r in got if r["error"] is None] == [(0, "QQQ"), (0, "SPY")]
    assert [r["page_seq"] for r in got if r["error"] == "missing data field"] == [2]
    assert [r["page_seq"] for r in got if r["error"] == "data is not a list of symbols"] == [3, 4, 5, 6]


def test_normalize(spark):
    raw = {
        "underlying_symbol": "EWZ",
        "type": "PUT",
        "exp_date": "2021-09-17",
        "tradetime": "2021-06-02",
        "strike": "31.5",
        "bid": "0.85",
        "volatility": "0.2",
        "venue": "X",
    }
    rows = spark.createDataFrame([(raw, 1), ({"strike": "bad", "tradetime": "2024"}, 2)], "record map<string,string>, seq int")
    out = normalize_quotes(rows)
    assert out.columns == [*OPTION_COLUMNS, "extras", "seq"]
    kinds = {f.name: f.dataType for f in OPTIONS_SCHEMA}
    assert all(f.dataType == kinds[f.name] for f in out.schema if f.name in kinds)
    first, second = out.orderBy("seq").collect()
    assert first["option_type"] == "put" and first["strike"] == 31.5 and first["bid"] == 0.85
    assert first["expiration"] == date(2021, 9, 17) and first["quote_date"] == date(2021, 6, 2)
    assert first["implied_volatility"] == 0.2 and first["extras"] == {"venue": "X"}
    assert second["strike"] is None and second["quote_date"] is None and second["extras"] == {}


def test_prices_from_quotes(spark):
    schema = "symbol string, timestamp bigint, open double, high double, low double, close double, adjclose double, volume bigint"
    rows = [
        ("SPY", 1704067200, 1.0, 2.0, 0.5, 1.5, 1.5, 10),
        ("SPY", 1704153599, 1.0, 2.0, 0.5, 1.5, 1.5, 11),
        ("SPY", -1, 1.0, 2.0, 0.5, 1.5, 1.5, 12),
        ("SPY", -(2**63), 1.0, 2.0, 0.5, 1.5, 1.5, 13),
        ("BAD", 2**63 - 1, 1.0, 2.0, 0.5, 1.5, 1.5, 14),
    ]
    raw = spark.createDataFrame(rows, schema)
    out = quotes.prices_from_quotes(raw)
    assert out.columns == PRICES_SCHEMA.names
    got = {r["volume"]: r["date"] for r in out.collect()}
    assert got == {10: date(2024, 1, 1), 11: date(2024, 1, 1), 12: date(1969, 12, 31)}
    errors = {r["symbol"]: (r["n_quotes"], r["n_valid"], r["error"]) for r in quotes.quote_errors(raw).collect()}
    assert errors == {"SPY": (4, 3, None), "BAD": (1, 0, "no quote of BAD has a usable time")}


def test_ingest_stays_in_the_jvm(spark):
    pages = spark.createDataFrame([page([["1"]], FIELDS)], ENVELOPE_SCHEMA)
    plan = normalize_quotes(envelope.page_rows(pages).drop("symbol"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
