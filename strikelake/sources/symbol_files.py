"""Foreign lakes with one Parquet file per symbol: ``<root>/<dataset>/<SYMBOL>.parquet``.

Files are planned by their footers, which hold the schema, the rows and the least and greatest dates: each
file is opened once for that, by several threads of the driver, and its columns are not read. Files of
one schema are then read together, each once and strictly: damage that a footer does not show fails the
read. A file whose footer cannot be read is listed with the reason and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strikelake.functions import parse_date
from strikelake.operators.merge import coerce
from strikelake.schemas import dataset, empty_table

# Names that a file's date column may have.
DATE_COLUMNS = ("quote_date", "date")
THREADS = 16

_LISTING = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("size_bytes", T.LongType())]
)
_STATUS = "symbol string, size_bytes bigint, row_count bigint, date_min date, date_max date, problem string"
_EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class Footer:
    """What a file's footer says. ``schema`` is its text, None where the file cannot be read."""

    path: str
    size_bytes: int
    schema: str | None = None
    row_count: int = 0
    date_min: date | None = None
    date_max: date | None = None
    dated: bool = True
    problem: str | None = None


def _pattern(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}/*.parquet"


def _symbol(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.parquet$", 1)


def _day(value) -> date | None:
    """A date from a footer's least or greatest value: days since 1970, or text that begins with one."""
    if isinstance(value, int):
        return _EPOCH + timedelta(days=value)
    try:
        return date.fromisoformat(value.toStringUsingUTF8()[:10])
    except ValueError:
        return None


def _date_range(blocks: Iterable) -> tuple[date | None, date | None, bool]:
    """Least and greatest date over the row groups, and whether the footer tells them."""
    lows, highs = [], []
    for block in blocks:
        chunks = {c.getPath().toDotString(): c for c in block.getColumns()}
        chunk = next((chunks[c] for c in DATE_COLUMNS if c in chunks), None)
        if chunk is None:
            continue
        found = chunk.getStatistics()
        if found is None or found.isEmpty():
            return None, None, False
        if not found.hasNonNullValue():
            continue  # nothing but nulls
        kind = chunk.getPrimitiveType().toString()
        if not ("(DATE)" in kind or "(STRING)" in kind or "(UTF8)" in kind):
            return None, None, False
        lows.append(_day(found.genericGetMin()))
        highs.append(_day(found.genericGetMax()))
    if None in lows or None in highs:
        return None, None, False
    return min(lows, default=None), max(highs, default=None), True


def _footer(spark: SparkSession, path: str, size_bytes: int) -> Footer:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.parquet.hadoop
    try:
        found = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
    except Py4JJavaError as e:
        return Footer(path, size_bytes, problem=str(e.java_exception.getMessage()))
    try:
        footer = found.getFooter()
        low, high, told = _date_range(footer.getBlocks())
        schema = footer.getFileMetaData().getSchema().toString()
        return Footer(path, size_bytes, schema, found.getRecordCount(), low, high, told)
    finally:
        found.close()


def _listed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Path and bytes of each file, without opening it."""
    dataset(name)
    try:
        return spark.read.format("binaryFile").load(_pattern(root, name)).select("path", "length")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def footers(spark: SparkSession, root: str, name: str) -> list[Footer]:
    """The footers of all files of a dataset: one short record per file."""
    listing = _listed(spark, root, name)
    if listing is None:
        return []
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(lambda r: _footer(spark, r["path"], r["length"]), sorted(listing.collect())))


def _read_planned(spark: SparkSession, name: str, planned: list[Footer]) -> DataFrame:
    """The rows of the files whose footers are given, with the lake's types and ``_path``."""
    ds = dataset(name)
    by_schema: dict[str, list[str]] = {}
    for f in planned:
        if f.schema is not None and f.row_count:
            by_schema.setdefault(f.schema, []).append(f.path)
    wanted = {*ds.schema.names, *DATE_COLUMNS} - {ds.symbol}
    every = None
    for paths in by_schema.values():
        # Spark's own view of one file's schema; unsigned numbers become wide ones.
        own = [x for x in spark.read.parquet(paths[0]).schema if x.name in wanted]
        files = spark.read.schema(T.StructType(own)).option("ignoreCorruptFiles", "false").parquet(*paths)
        rows = files.withColumns({ds.symbol: _symbol(F.col("_metadata.file_name")), "_path": F.col("_metadata.file_path")})
        have = [c for c in DATE_COLUMNS if c in rows.columns]
        days = [F.col(c) if isinstance(rows.schema[c].dataType, T.DateType) else parse_date(F.col(c).cast("string")) for c in have]
        day = F.coalesce(*days) if days else F.lit(None).cast("date")
        typed = coerce(rows.withColumn(ds.date, day).drop(*[c for c in have if c != ds.date]), ds)
        missing = {c: F.lit(None).cast(t) for c, t in ds.types.items() if c not in typed.columns}
        typed = typed.withColumns(missing).select(*ds.schema.names, "_path")
        every = typed if every is None else every.unionByName(typed)
    if every is None:
        return empty_table(spark, T.StructType([*ds.schema.fields, T.StructField("_path", T.StringType())]))
    return every


def read_symbol_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All files of a dataset as one table with the lake's types, the symbol from the file name.

    Files may differ in columns, in the name of their date column and in the types of dates and
    numbers. Each is read once. One without a readable footer gives no rows, and
    :func:`symbol_file_status` names it with the reason; one that is damaged further in fails the read
    rather than giving part of its rows. No files give an empty table.
    """
    return _read_planned(spark, name, footers(spark, root, name)).drop("_path")


def list_symbol_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Symbol and bytes of each file, without opening it."""
    listing = _listed(spark, root, name)
    if listing is None:
        return empty_table(spark, _LISTING)
    return listing.select(_symbol(F.col("path")).alias("symbol"), F.col("length").alias("size_bytes"))


def symbol_file_status(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Bytes, rows and date range of each file, and the ``problem`` of one that cannot be read.

    From the footers alone; the dates are read only of files whose footers leave them open.
    """
    ds, planned = dataset(name), footers(spark, root, name)
    rows = [(f.path, f.size_bytes, f.row_count, f.date_min, f.date_max, f.problem) for f in planned]
    told = spark.createDataFrame(rows, _STATUS.replace("symbol", "path", 1)) if rows else None
    if told is None:
        return empty_table(spark, T.StructType.fromDDL(_STATUS))
    open_ = [f for f in planned if not f.dated]
    if open_:
        days = _read_planned(spark, name, open_).groupBy(F.col("_path").alias("path"))
        days = days.agg(F.min(ds.date).alias("_low"), F.max(ds.date).alias("_high"))
        told = told.join(days, "path", "left").withColumns(
            {"date_min": F.coalesce("date_min", "_low"), "date_max": F.coalesce("date_max", "_high")}
        )
    return told.select(
        _symbol(F.col("path")).alias("symbol"), "size_bytes", "row_count", "date_min", "date_max", "problem"
    )
