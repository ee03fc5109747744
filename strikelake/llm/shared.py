"""Small helpers of the operators: intermediate tables in the shared folder, prefix sums, text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

SPACE_RUN = r"[\x20\x09-\x0D]+"
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("_PASSING", default=())


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary one; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="strikelake-llm-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def store(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut in the lineage that outlives executors.

    The folder is the cluster's to expire; a table may still be read when the caller's result is. Inside
    ``passing`` tables go at its end; a ``lasting`` one outlives the innermost.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    around = _PASSING.get()[:-1] if lasting else _PASSING.get()
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end; what is handed out must read ``lasting`` ones alone."""
    paths: list[str] = []
    outer = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(outer)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, size: int = 2 << 20) -> Iterator[None]:
    """Rows that Python reads while tables are stored inside come in batches of about ``size`` bytes at most.

    A batch stands in the executor's direct memory and in its worker at once, and neither gives all of it back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def prefix_sums(df: DataFrame, index: str, value: str, out: str, group: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over all rows of a smaller ``index`` (whole numbers from 0, no repeats).

    In two levels, so that one task adds up a 4096th of the rows, or one group of them.
    """
    part = F.floor(F.col(index) / group)
    sums = df.groupBy(part.alias("_part")).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_start")
    )


def ranked(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Stored rows with ``_pos``, the place in their group from 0 by ``order``, and ``_total``, its size.

    One range exchange by group and order cuts a hot group like any other rows; places inside a
    partition come from the sort and those before it from one row per group and partition. Nulls are
    a group and come first. Rows that ``order`` does not tell apart are numbered as the scan has them,
    and are cut among partitions too.
    """
    spread = df.withColumn("_spread", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first(c) for c in [*group, *order, "_spread"]]
    rows = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_spread")
    rows = store(rows.withColumn("_at", F.monotonically_increasing_id()), label)
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    piles = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = piles.select(
        F.col("_part").alias("_p"),
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("_total"),
    )
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("_pos"), "_total")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = 1 << 20):
    """Runs of rows of about ``size`` bytes: (first row, bytes, offsets). A longer row stands alone."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task: its Python worker lives on for others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **columns) -> pa.RecordBatch:
    """The batch with columns added, without those that they replace or ``drop`` names."""
    keep = [n for n in batch.schema.names if n not in columns and n not in drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in keep] + list(columns.values()), names=keep + list(columns)
    )


def schema_with(df: DataFrame, drop: tuple[str, ...] = (), **columns: str) -> T.StructType:
    """The schema of ``with_columns``' result; types of the input's columns are handed on as they are."""
    kept = [f for f in df.schema.fields if f.name not in columns and f.name not in drop]
    return T.StructType([*kept, *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in columns.items()]])
