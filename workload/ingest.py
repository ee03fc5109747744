"""Ingest: pages of JSON that Spark makes from the tables, and raw quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strikelake.operators.normalize import normalize_quotes
from strikelake.plans.run import load_pages
from strikelake.sources import envelope
from strikelake.sources.quotes import prices_from_quotes, quote_errors
from strikelake.sources.lake import Lake
from strikelake.streaming.ingest import ingest_stream, read_landing
from workload import views
from workload.merges import _OUT, _corrections, upsert_sql
from workload.registry import query

# Names in the pages, and the SQL and Spark sources of their texts.
_FIELDS = (
    "underlying_symbol",
    "type",
    "exp_date",
    "expiration_type",
    "tradetime",
    "strike",
    "bid",
    "ask",
    "last",
    "delta",
)
_COLUMNS = (
    "underlying_symbol",
    "option_type",
    "expiration",
    "expiration_type",
    "quote_date",
    "strike",
    "bid",
    "ask",
    "last",
    "delta",
)
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _json_row(columns: list[Column]) -> Column:
    """A JSON array of texts; nulls stay as JSON nulls."""
    return F.to_json(F.array(*columns), {"ignoreNullFields": "false"})


def compact_pages(quotes: DataFrame, *carried: str, dataset: str = "options") -> DataFrame:
    """One page per quote: its row, a short row with a null, a long row, and two non-rows."""
    full = [F.col(c).cast("string") for c in _COLUMNS]
    null = F.lit(None).cast("string")
    data = F.concat(
        F.lit("["),
        _json_row(full),
        F.lit(","),
        _json_row([*full[:5], null, full[6]]),
        F.lit(',5,{"strike":1},'),
        _json_row([*full, F.lit("surplus")]),
        F.lit("]"),
    )
    return quotes.select(
        *carried,
        F.struct(F.array(*[F.lit(f) for f in _FIELDS]).alias("fields")).alias("meta"),
        data.alias("data"),
        F.struct(F.lit(None).cast("string").alias("next")).alias("links"),
    )


def _entries_text(record: Column) -> Column:
    """A record as sorted ``name=value`` text, to compare maps between engines."""
    pairs = F.zip_with(F.map_keys(record), F.map_values(record), lambda k, v: F.concat(k, F.lit("="), v))
    return F.array_join(F.sort_array(pairs), ",").alias("entries")


def _sorted_pairs_sql(names: tuple[str, ...], columns: tuple[str, ...]) -> str:
    pairs = ", ".join(
        f"'{n}=' || CAST({c} AS VARCHAR)" for n, c in zip(names, columns, strict=True)
    )
    return f"array_to_string(list_sort([{pairs}]), ',')"


_ALL_PAIRS = _sorted_pairs_sql(_FIELDS, _COLUMNS)
_SHORT = [i for i in range(7) if i != 5]
_SHORT_PAIRS = _sorted_pairs_sql(tuple(_FIELDS[i] for i in _SHORT), tuple(_COLUMNS[i] for i in _SHORT))
_ORDER_SQL = ", ".join(_ORDER)


@query(
    "ingest_compact",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT {_ORDER_SQL}, 0 AS pos, {_ALL_PAIRS} AS entries FROM quotes
UNION ALL SELECT {_ORDER_SQL}, 1, {_SHORT_PAIRS} FROM quotes
UNION ALL SELECT {_ORDER_SQL}, 4, {_ALL_PAIRS} FROM quotes""",
)
def ingest_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = compact_pages(views.spread(views.exchange_quotes(spark, sf_dir)), *_ORDER)
    return envelope.compact_rows(pages).select(*_ORDER, "pos", _entries_text(F.col("record")))


def standard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per event: wrapped, bare, non-objects, and an ``attributes`` that is no object."""
    props = F.col("props")
    data = F.concat(
        F.lit('[{"id":"x","attributes":'),
        props,
        F.lit("},"),
        props,
        F.lit(',5,"text",null,[1],{"attributes":3,"ok":true,"none":null,"deep":{"a":[1,2]},"value":'),
        F.col("value").cast("string"),
        F.lit("}]"),
    )
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(F.lit(None).cast("array<string>").alias("fields")).alias("meta"),
        data.alias("data"),
        F.struct(F.lit(None).cast("string").alias("next")).alias("links"),
    )


@query(
    "ingest_standard",
    """
SELECT event_id, pos, 'k=' || json_extract_string(props, '$.k') AS entries
FROM events CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1)
UNION ALL
SELECT event_id, 6, 'attributes=3,deep={"a":[1,2]},ok=true,value=' || CAST(value AS VARCHAR) FROM events""",
)
def ingest_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = envelope.standard_rows(standard_pages(spark, sf_dir))
    return rows.select("event_id", "pos", _entries_text(F.col("record")))


@query(
    "ingest_envelope",
    """
SELECT 'compact' AS source, pos, CASE pos WHEN 1 THEN 6 ELSE 10 END AS n_fields, count(*) AS n,
  CASE WHEN pos <> 1 THEN sum(l_quantity) END AS strikes
FROM lineitem CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 4) GROUP BY 2
UNION ALL
SELECT 'standard', pos, CASE pos WHEN 6 THEN 4 ELSE 1 END, count(*), NULL
FROM events CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 6) GROUP BY 2""",
)
def ingest_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms in one load, with pages that hold nothing, null, no array, or no JSON."""
    compact = compact_pages(views.spread(views.exchange_quotes(spark, sf_dir))).withColumn("source", F.lit("compact"))
    standard = standard_pages(spark, sf_dir).drop("event_id").withColumn("source", F.lit("standard"))
    status = F.col("o_orderstatus")
    empty = views.table(spark, sf_dir, "orders").select(
        F.struct(F.array().cast("array<string>").alias("fields")).alias("meta"),
        F.when(status == "P", F.lit(None).cast("string"))
        .when(status == "F", "[]")
        .when(F.col("o_orderpriority") == "5-LOW", '[{"a":1')
        .otherwise('{"strike":"1"}')
        .alias("data"),
        F.struct(F.lit(None).cast("string").alias("next")).alias("links"),
        F.lit("empty").alias("source"),
    )
    rows = envelope.page_rows(compact.unionByName(standard).unionByName(empty))
    return rows.groupBy("source", "pos", F.size("record").alias("n_fields")).agg(
        F.count("*").alias("n"), F.sum(F.col("record")["strike"].try_cast("double")).alias("strikes")
    )


@query(
    "unreadable_pages",
    """SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' OR o_orderstatus = 'O'""",
)
def unreadable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    broken = (F.col("o_orderpriority") == "5-LOW") | (F.col("o_orderstatus") == "O")
    pages = orders.select(
        "o_orderkey",
        F.when(broken, F.concat(F.lit('[["'), "o_orderkey", F.lit('", ')))
        .when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit('{"k":'), "o_orderkey", F.lit("}")))
        .alias("data"),
    )
    return envelope.unreadable_pages(pages)


@query(
    "normalize_quotes",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT {_ORDER_SQL}, underlying_symbol, lower(option_type) AS option_type,
  CASE WHEN l_linenumber <> 7 THEN expiration END AS expiration, expiration_type,
  CASE WHEN l_linenumber <> 6 THEN quote_date END AS quote_date,
  CASE WHEN strike <> 13 THEN strike END AS strike, bid,
  CASE WHEN ask <> 0.02 THEN ask END AS ask, last, delta AS implied_volatility,
  CAST(NULL AS DOUBLE) AS gamma, 'venue=' || option_type AS extras
FROM quotes""",
)
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = views.exchange_quotes(spark, sf_dir)

    def text(c: str) -> Column:
        return F.col(c).cast("string")

    fields = {
        "underlying_symbol": text("underlying_symbol"),
        "type": text("option_type"),
        "exp_date": F.when(F.col("l_linenumber") != 7, text("expiration")).otherwise("2024"),
        "expiration_type": text("expiration_type"),
        "tradetime": F.when(F.col("l_linenumber") != 6, F.concat(text("quote_date"), F.lit(" 10:00:00")))
        .otherwise("yesterday"),
        "strike": F.when(F.col("strike") != 13, text("strike")).otherwise("n/a"),
        "bid": text("bid"),
        "ask": F.when(F.col("ask") != 0.02, text("ask")).otherwise("1.5f"),
        "last": text("last"),
        "volatility": text("delta"),
        "venue": text("option_type"),
    }
    record = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    rows = normalize_quotes(quotes.select(*_ORDER, record.alias("record")))
    return rows.select(
        *_ORDER,
        "underlying_symbol",
        "option_type",
        "expiration",
        "expiration_type",
        "quote_date",
        "strike",
        "bid",
        "ask",
        "last",
        "implied_volatility",
        "gamma",
        _entries_text(F.col("extras")).alias("extras"),
    )


def _seconds(ts: Column) -> Column:
    """Epoch seconds of a wall-clock time, in any session zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _event_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes of their type; those of type ``error`` have an impossible time."""
    value = F.col("value")
    return views.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.when(F.col("event_type") == "error", F.lit(-(2**63)))
        .otherwise(_seconds(F.col("ts")))
        .alias("timestamp"),
        *[(value + i).alias(c) for i, c in enumerate(("open", "high", "low", "close", "adjclose"))],
        F.col("user_id").alias("volume"),
        "event_id",
    )


@query(
    "ingest_prices",
    """
SELECT event_type AS symbol, CAST(ts AS DATE) AS date, value AS open, value + 1 AS high,
  value + 2 AS low, value + 3 AS close, value + 4 AS adjclose, user_id AS volume, event_id
FROM events WHERE event_type <> 'error'""",
)
def ingest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = prices_from_quotes(_event_quotes(spark, sf_dir))
    return bars.withColumn("open", F.col("open") + 0)


@query(
    "quote_errors",
    """
SELECT event_type AS symbol, count(*) AS n_quotes,
  CAST(count_if(event_type <> 'error') AS BIGINT) AS n_valid,
  CASE WHEN event_type = 'error' THEN 'no quote of error has a usable time' END AS error
FROM events GROUP BY 1""",
)
def quote_load_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_errors(_event_quotes(spark, sf_dir))


@query(
    "symbol_universe",
    """
SELECT p_partkey, p_brand AS symbol, CAST(NULL AS VARCHAR) AS error FROM part
WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'PROMO')
UNION ALL
SELECT p_partkey, p_name, NULL FROM part WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'PROMO')
UNION ALL
SELECT p_partkey, NULL, 'missing data field' FROM part WHERE p_type = 'ECONOMY'
UNION ALL
SELECT p_partkey, NULL, 'data is not a list of symbols' FROM part WHERE p_type IN ('SMALL', 'PROMO')""",
)
def symbol_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    pages = views.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(kind == "ECONOMY", F.lit(None).cast("string"))
        .when(kind == "SMALL", F.concat(F.lit('["A",'), "p_partkey", F.lit("]")))
        .when(kind == "PROMO", F.concat(F.lit('{"symbol":"'), "p_brand", F.lit('"}')))
        .otherwise(F.to_json(F.array("p_brand", "p_name")))
        .alias("data"),
    )
    return envelope.symbol_universe(pages)


@query("stream_ingest", upsert_sql("lower(option_type)"))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of pages land as files and are streamed into a lake, in two runs."""
    scratch = views.scratch_dir(spark, "stream")
    quotes = views.spread(views.exchange_quotes(spark, sf_dir))
    lake = views.scratch_lake(spark, "stream-lake")
    for load in (quotes, _corrections(quotes)):
        pages = stream_pages(load)
        # The names of the fields stand in every page, so that the pages are mostly repeats: the fastest level packs them.
        packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
        pages.write.mode("append").options(**packed).json(f"{scratch}/landing")
        landed = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1000).json(f"{scratch}/landing")
        ingest_stream(landed, lake, f"{scratch}/checkpoint").awaitTermination()
    return lake.scan("options").select(*_OUT)


def stream_pages(quotes: DataFrame, symbol: Column | None = None) -> DataFrame:
    """One options page per quote; its sequence is the arrival order of the quote."""
    full = [F.col(c).cast("string") for c in _COLUMNS]
    return quotes.select(
        F.lit("options").alias("dataset"),
        (F.lit(None).cast("string") if symbol is None else symbol).alias("symbol"),
        F.struct(*views.ARRIVAL).alias("page_seq"),
        F.struct(F.array(*[F.lit(f) for f in _FIELDS]).alias("fields")).alias("meta"),
        F.concat(F.lit("["), _json_row(full), F.lit("]")).alias("data"),
        F.struct(F.lit(None).cast("string").alias("next")).alias("links"),
    )


def _priced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prices page per event, of its type; ``error`` has impossible times, ``view`` also broken pages."""
    events = views.table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    seconds = F.when(failed, F.lit(-(2**63))).otherwise(_seconds(F.col("ts")))
    bar = F.to_json(
        F.array(
            F.struct(
                seconds.alias("timestamp"),
                *[F.col("value").alias(c) for c in ("open", "high", "low", "close", "adjclose")],
                F.col("user_id").alias("volume"),
            )
        )
    )
    broken = (F.col("event_type") == "view") & (F.col("value") < 10)
    return events.select(
        F.lit("prices").alias("dataset"),
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("page_seq"),
        F.struct(F.lit(None).cast("array<string>").alias("fields")).alias("meta"),
        F.when(broken, F.concat(F.lit("["), bar)).otherwise(bar).alias("data"),
        F.struct(F.lit(None).cast("string").alias("next")).alias("links"),
    )


@query(
    "load_run",
    f"""
WITH {views.EXCHANGE_QUOTES},
o AS (
  SELECT underlying_symbol AS symbol, count(*) AS n,
    count(DISTINCT (quote_date, expiration, strike, lower(option_type), expiration_type)) AS total,
    min(quote_date) AS lo, max(quote_date) AS hi
  FROM quotes GROUP BY 1),
e AS (
  SELECT event_type, CAST(ts AS DATE) AS date, event_type = 'view' AND value < 10 AS broken FROM events),
p AS (
  SELECT event_type AS symbol, CAST(count_if(broken) AS BIGINT) AS broken,
    CAST(CASE WHEN event_type = 'error' THEN 0 ELSE count_if(NOT broken) END AS BIGINT) AS n,
    CASE WHEN event_type = 'error' THEN 0
      ELSE count(DISTINCT CASE WHEN NOT broken THEN date END) END AS total,
    CASE WHEN event_type <> 'error' THEN min(CASE WHEN NOT broken THEN date END) END AS lo,
    CASE WHEN event_type <> 'error' THEN max(CASE WHEN NOT broken THEN date END) END AS hi
  FROM e GROUP BY 1)
SELECT symbol, 'chains' AS provider, 'options' AS category, n AS new_rows, 0 AS rejected_rows,
  total AS total_rows, lo AS date_min, hi AS date_max, 'OK' AS status, '' AS message FROM o
UNION ALL
SELECT upper(symbol), 'bars', 'prices', n, 0, total, lo, hi,
  CASE WHEN symbol = 'error' THEN 'FAILED' WHEN broken > 0 THEN 'WARNING' ELSE 'OK' END,
  CASE WHEN symbol = 'error' THEN 'no quote of ERROR has a usable time'
    WHEN broken > 0 THEN broken || ' page(s) are no JSON' ELSE '' END
FROM p""",
)
def load_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options pages of all lines and prices pages of all events in one load, with its report."""
    lines = stream_pages(views.spread(views.exchange_quotes(spark, sf_dir)))
    options = lines.withColumns(
        {
            "symbol": F.get_json_object("data", "$[0][0]"),
            "page_seq": F.col("page_seq.l_orderkey"),
        }
    )
    events = _priced_pages(spark, sf_dir)
    scratch = views.scratch_dir(spark, "load-run")
    lake = views.scratch_lake(spark, "load-lake")
    pages = options.unionByName(events)
    return load_pages(lake, pages, scratch, {"options": "chains", "prices": "bars"})


def _hard_load(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake after one load whose symbols come, by line number, in lower case, only on the page, or unusable."""
    line = F.col("l_linenumber")
    none = F.lit(None).cast("string")
    asked = F.when(line == 4, none).otherwise(F.lower("underlying_symbol"))
    own = F.when(line == 1, F.lower("underlying_symbol")).when(line == 3, "no/good").when(line.isin(2, 4), none)
    quotes = views.spread(views.exchange_quotes(spark, sf_dir)).withColumn("asked", asked)
    quotes = quotes.withColumn("underlying_symbol", own.otherwise(F.col("underlying_symbol")))
    lake = views.scratch_lake(spark, "hard-lake")
    load_pages(
        lake,
        stream_pages(quotes, F.col("asked")).withColumn("page_seq", F.col("page_seq.l_orderkey")),
        views.scratch_dir(spark, "hard-load"),
        {"options": "chains", "prices": "bars"},
    )
    return lake


@query(
    "load_rejects",
    f"""
WITH {views.EXCHANGE_QUOTES}
SELECT CASE WHEN l_linenumber = 3 THEN 'no/good' END AS symbol,
  CASE WHEN l_linenumber = 3 THEN 'invalid symbol' ELSE 'no symbol' END AS reason, count(*) AS n_rows,
  max(last) AS last_max
FROM quotes WHERE l_linenumber IN (3, 4) GROUP BY 1, 2""",
)
def load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load could not store, by symbol and reason."""
    rejects = _hard_load(spark, sf_dir).rejects("options")
    return rejects.groupBy(F.col("underlying_symbol").alias("symbol"), "reason").agg(
        F.count("*").alias("n_rows"), F.max("last").alias("last_max")
    )


@query(
    "load_run_rows",
    f"""
WITH {views.EXCHANGE_QUOTES},
usable AS (
  SELECT * REPLACE (lower(option_type) AS option_type) FROM quotes WHERE l_linenumber NOT IN (3, 4)),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY {views.KEYS}, l_orderkey) AS tied,
    max(l_orderkey) OVER (PARTITION BY {views.KEYS}) AS newest FROM usable)
SELECT {views.KEYS}, max(CASE WHEN tied = 1 THEN last END) AS last FROM ranked
WHERE l_orderkey = newest GROUP BY ALL""",
)
def load_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows after that load. Where the page sequence ties, any of the tied rows may stand."""
    stored = _hard_load(spark, sf_dir).scan("options")
    keys = views.KEYS.split(", ")
    quotes = views.exchange_quotes(spark, sf_dir).withColumn("option_type", F.lower("option_type"))
    usable = quotes.filter(~F.col("l_linenumber").isin(3, 4))
    counts = usable.groupBy(*keys, "l_orderkey").agg(F.count("*").alias("tied"))
    newest = counts.groupBy(*keys).agg(F.max_by("tied", "l_orderkey").alias("tied"))
    joined = stored.select(*keys, "last").join(newest, keys)
    return joined.select(*keys, F.when(F.col("tied") == 1, F.col("last")).alias("last"))


@query(
    "stream_prices",
    """
WITH e AS (
  SELECT upper(event_type) AS symbol, CAST(ts AS DATE) AS date, value, event_id FROM events
  WHERE event_type <> 'error' AND NOT (event_type = 'view' AND value < 10))
SELECT symbol, date, max_by(value, event_id) AS close, count(*) > 0 AS stored FROM e GROUP BY 1, 2""",
)
def stream_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices pages land as files and are streamed into a lake; the last page of a day stands."""
    scratch = views.scratch_dir(spark, "stream-prices")
    lake = views.scratch_lake(spark, "stream-prices-lake")
    _priced_pages(spark, sf_dir).write.json(f"{scratch}/landing")
    ingest_stream(read_landing(spark, f"{scratch}/landing"), lake, f"{scratch}/checkpoint").awaitTermination()
    return lake.scan("prices").select("symbol", "date", "close", F.lit(True).alias("stored"))
