"""Landing directory to lake as a file stream.

No watermark: a late page is merged like any other, and a key that comes again replaces the
older row. Each dataset notes the micro-batches it holds in the commit that stores them, so a batch that
is replayed after a failure changes nothing, whichever of the datasets it had reached.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strikelake.operators.normalize import normalize_quotes
from strikelake.schemas import ENVELOPE_SCHEMA, PRICE_LEVELS
from strikelake.sources.envelope import page_rows
from strikelake.sources.lake import Lake
from strikelake.sources.quotes import prices_from_quotes

ARRIVAL = ("page_seq", "pos")
_PRICED = "_priced"


def quotes_of(rows: DataFrame) -> DataFrame:
    """Records of price pages as raw quotes."""
    r = F.col("record")
    return rows.select(
        "symbol",
        "page_seq",
        "pos",
        r["timestamp"].try_cast("bigint").alias("timestamp"),
        *[r[c].try_cast("double").alias(c) for c in PRICE_LEVELS],
        r["volume"].try_cast("bigint").alias("volume"),
    )


def identified_quotes(pages: DataFrame) -> DataFrame:
    """Normalised quotes of options pages; a record that names no symbol has that of its page."""
    return identified(page_rows(pages))


def identified(rows: DataFrame) -> DataFrame:
    """The same of records."""
    quotes = normalize_quotes(rows)
    return quotes.withColumn("underlying_symbol", F.coalesce("underlying_symbol", "symbol"))


def write_batch(lake: Lake, stream: str, price_mode: str = "merge") -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body: options pages are upserted, price pages stored.

    Pages are parsed once, into a staging table that both datasets load from: quotes of options in their
    columns, records of prices as they are. ``stream`` names the query whose batches these are; a batch that
    both datasets hold is not even parsed.
    """

    def write(pages: DataFrame, batch_id: int) -> None:
        batch, names = (stream, batch_id), ("options", "prices")
        if all(lake.state(n).holds(batch) for n in names):
            return
        path = f"{lake.root}/staging/{uuid.uuid4().hex}"
        rows = page_rows(pages.filter(F.col("dataset").isin(*names)))
        own = {n: F.when(F.col("dataset") == n, F.col("record")) for n in names}
        # No folder per dataset: the writer would sort every row for it. Files tell what they hold by their footers.
        parsed = identified(rows.withColumns({"record": own["options"], _PRICED: own["prices"]}))
        parsed.write.parquet(path)
        stored = lake.spark.read.schema(parsed.schema).parquet(path)
        options, prices = (stored.filter(F.col("dataset") == n).drop("dataset") for n in names)
        lake.upsert_options(options.drop("symbol", _PRICED), ARRIVAL, batch, staged=True)
        quotes = quotes_of(prices.select("symbol", "page_seq", "pos", F.col(_PRICED).alias("record")))
        lake.write_prices(prices_from_quotes(quotes), ARRIVAL, price_mode, batch, staged=True)
        lake.discard(path)

    return write


def read_landing(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    """Stream of pages, one JSON document per line, at most ``max_files`` files in a micro-batch."""
    reader = spark.readStream.schema(ENVELOPE_SCHEMA).option("maxFilesPerTrigger", max_files)
    return reader.json(landing)


def ingest_stream(
    pages: DataFrame, lake: Lake, checkpoint: str, price_mode: str = "merge"
) -> StreamingQuery:
    """Write every page that has landed, then stop; run it again for what lands later.

    The checkpoint's path stands for the query in the lake's log.
    """
    return (
        pages.writeStream.foreachBatch(write_batch(lake, checkpoint, price_mode))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
