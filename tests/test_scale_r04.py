"""What a stream of pages costs: parsing, staging and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.operators.normalize import normalize_quotes
from strikelake.schemas import ENVELOPE_SCHEMA
from strikelake.sources import envelope
from strikelake.sources.lake import Lake
from strikelake.streaming.ingest import write_batch
from tests.test_ingest import FIELDS, page, records
from tests.test_run import options_page, price_page, row


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _raw(text, fields=FIELDS):
    return ("options", None, 1, (fields,), text, (None,))


def test_pages_of_rows_are_parsed_at_once(spark):
    """with the same records as element by element, whatever else is in a page."""
    texts = [
        '[["1","2","3"],["4",null],[],["5","6","7","8"]]',
        '[["1",2.50,1E5],[true,[1, 2],-0.0]]',
        '[["1",1e400,NaN]]',
        '[["1",["x"],"3"]]',
        '[["a\\"b","2","3"]]',
        '[["1","2","3"],5,"[4]",null,{"strike":[1]}]',
        '[["1","2","3"],["4"',
        "[[]]",
        "[[",
        ' [["1"]]',
        None,
    ]
    names = [FIELDS, ["a", "a", "b"], ["a", None, "b"], ["\0", "a"], ["a"]]
    made = spark.createDataFrame([_raw(t, n) for t in texts for n in names], ENVELOPE_SCHEMA)
    pages = made.withColumn("page_seq", F.monotonically_increasing_id())

    def told(rows):
        entries = F.array_sort(F.map_entries("record")).cast("string")
        return sorted(tuple(r) for r in rows.select("page_seq", "pos", entries).collect())

    assert told(envelope.page_rows(pages)) == told(envelope.compact_rows(pages))
    plain = pages.select("data", envelope._all_plain(envelope._rows_at_once(F.col("data"))).alias("plain"))
    assert {r["data"] for r in plain.filter("plain").collect()} == {texts[0], texts[1], "[[]]"}
    assert "ArrayType(ArrayType(StringType,true),true)" in _plan(envelope.page_rows(pages))
    one = spark.createDataFrame([page([["1", "2", "3"], ["4"]], FIELDS)], ENVELOPE_SCHEMA)
    assert records(envelope.page_rows(one)) == [{"strike": "1", "bid": "2", "type": "3"}, {"strike": "4"}]


def test_extras_are_looked_for_only_where_fields_are_left_over(spark):
    """known fields by either name, unknown ones, values that are null, and no record at all."""
    made = [
        ({"strike": "1", "type": "Call"},),
        ({"strike": "1", "option_type": "Put", "type": "Call"},),
        ({"strike": "1", "venue": "X"},),
        ({"strike": None, "bid": "2"},),
        ({"strike": None, "venue": "X"},),
        ({},),
        (None,),
    ]
    rows = normalize_quotes(spark.createDataFrame(made, "record map<string,string>"))
    got = [(r["strike"], r["option_type"], r["extras"]) for r in rows.collect()]
    assert got == [
        (1.0, "call", {}),
        (1.0, "call", {}),
        (1.0, None, {"venue": "X"}),
        (None, None, {}),
        (None, None, {"venue": "X"}),
        (None, None, {}),
        (None, None, None),
    ]
    assert "size(record" in _plan(rows)


def test_a_batch_is_staged_in_columns_and_without_a_sort(spark, tmp_path, monkeypatch):
    """quotes are typed once, before they are staged, and no row is sorted into a folder of its dataset."""
    seen = []
    discard = Lake.discard

    def noted(self, path):
        stored = self.spark.read.parquet(path)
        seen.append((dict(stored.dtypes), stored.inputFiles(), stored.select("dataset", "strike", "_priced").collect()))
        discard(self, path)

    monkeypatch.setattr(Lake, "discard", noted)
    made = [options_page("SPY", 1, row("SPY", "2024-01-15", "1", "5")), price_page("SPY", (1704067200, 10.0))]
    lake = Lake(spark, str(tmp_path))
    write_batch(lake, "stream")(spark.createDataFrame(made, ENVELOPE_SCHEMA), 0)
    kinds, files, rows = seen[0]
    assert kinds["strike"] == "double" and kinds["quote_date"] == "date" and "record" not in kinds
    assert not any("dataset=" in f for f in files)
    assert {(r["dataset"], r["strike"], r["_priced"] is None) for r in rows} == {("options", 1.0, True), ("prices", None, False)}
    assert lake.scan("options").count() == 1 and lake.scan("prices").count() == 1
