"""Fixed table shapes of the lake: options quotes and daily price bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# API field name -> column name of the options table.
API_FIELDS = {
    "underlying_symbol": "underlying_symbol",
    "type": "option_type",
    "exp_date": "expiration",
    "expiration_type": "expiration_type",
    "tradetime": "quote_date",
    "strike": "strike",
    "bid": "bid",
    "ask": "ask",
    "last": "last",
    "open": "open",
    "high": "high",
    "low": "low",
    "volume": "volume",
    "open_interest": "open_interest",
    "delta": "delta",
    "gamma": "gamma",
    "theta": "theta",
    "vega": "vega",
    "rho": "rho",
    "volatility": "implied_volatility",
    "midpoint": "midpoint",
    "moneyness": "moneyness",
    "theoretical": "theoretical",
    "dte": "dte",
}

# The options columns that are not numbers.
OPTION_DATES = ("quote_date", "expiration")
OPTION_STRINGS = ("underlying_symbol", "option_type", "expiration_type")

# Identity of an options row within its symbol.
OPTION_KEYS = ("quote_date", "expiration", "strike", "option_type", "expiration_type")

# Options columns that must not be null.
OPTION_REQUIRED = ("quote_date", "underlying_symbol", "option_type", "expiration", "strike")

# Options columns whose type must be numeric, and those tested for zeros.
OPTION_NUMERIC_CHECKED = ("strike", "bid", "ask", "last", "delta", "gamma", "theta", "vega")
OPTION_QUOTED_PRICES = ("bid", "ask", "last")

# Columns of the prices table.
PRICE_COLUMNS = ("date", "open", "high", "low", "close", "adjclose", "volume")
PRICE_LEVELS = ("open", "high", "low", "close", "adjclose")
PRICE_REQUIRED = ("date", "close")


def _option_type_of(name: str) -> T.DataType:
    if name in OPTION_DATES:
        return T.DateType()
    return T.StringType() if name in OPTION_STRINGS else T.DoubleType()


OPTION_COLUMNS = tuple(API_FIELDS.values())

OPTIONS_SCHEMA = T.StructType(
    [T.StructField(c, _option_type_of(c)) for c in OPTION_COLUMNS]
    + [T.StructField("extras", T.MapType(T.StringType(), T.StringType()))]
)

PRICES_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_LEVELS]
    + [T.StructField("volume", T.LongType())]
)

# One landed API page. ``data`` is an array of arrays, an array of objects or an array of
# strings depending on the page, so it is kept as JSON text.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("page_seq", T.LongType()),
        T.StructField("meta", T.StructType([T.StructField("fields", T.ArrayType(T.StringType()))])),
        T.StructField("data", T.StringType()),
        T.StructField("links", T.StructType([T.StructField("next", T.StringType())])),
    ]
)


@dataclass(frozen=True)
class Dataset:
    """What the operators need to know about one category of the lake."""

    name: str
    schema: T.StructType
    symbol: str
    date: str
    keys: tuple[str, ...]
    split: bool

    @property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.schema}

    def period(self, part: str) -> Column:
        """Directory of a row below its symbol: yyyymm or yyyy00, 0 for undated and unsplit rows.

        Option chains of one busy symbol can be a third of the lake, so they are split by time;
        price bars are one row per symbol and day and stay together.
        """
        if not self.split:
            return F.lit(0)
        d = F.col(self.date)
        month = F.month(d) if part == "month" else F.lit(0)
        return F.coalesce(F.year(d) * 100 + month, F.lit(0))


OPTIONS = Dataset("options", OPTIONS_SCHEMA, "underlying_symbol", "quote_date", OPTION_KEYS, True)
PRICES = Dataset("prices", PRICES_SCHEMA, "symbol", "date", ("date",), False)


def dataset(name: str) -> Dataset:
    """Look a category up by name; an unknown name is an error."""
    for known in (OPTIONS, PRICES):
        if known.name == name:
            return known
    raise ValueError(f"unknown dataset: {name!r} (expected 'options' or 'prices')")


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of a schema, without a Python-side source."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
