"""Merge of stored rows and new chunks: supertype union and keep-last deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strikelake.functions import parse_date, parse_double
from strikelake.schemas import OPTIONS, Dataset

STORED_FIRST = "_source_rank"


def _to_type(column: str, have: T.DataType, want: T.DataType) -> Column:
    c = F.col(column)
    if have == want:
        return c
    if isinstance(have, T.StringType) and isinstance(want, T.DateType):
        return parse_date(c).alias(column)
    if isinstance(have, T.StringType) and isinstance(want, T.DoubleType):
        return parse_double(c).alias(column)
    return c.try_cast(want).alias(column)


def coerce(df: DataFrame, ds: Dataset = OPTIONS) -> DataFrame:
    """Bring the columns that ``ds`` knows to its types; a value that does not fit is null."""
    types = ds.types
    return df.select(
        *[
            _to_type(f.name, f.dataType, types[f.name]) if f.name in types else F.col(f.name)
            for f in df.schema
        ]
    )


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def union_chunks(frames: Sequence[DataFrame], ds: Dataset = OPTIONS) -> DataFrame:
    """Diagonal union in the given order; a column missing on one side is null there.

    Known columns get their fixed type. Unknown columns of differing types widen when both are
    numbers and become text otherwise. ``_source_rank`` holds the position of the frame.
    """
    if not frames:
        raise ValueError("nothing to merge")
    typed = [coerce(f, ds) for f in frames]
    seen: dict[str, set[T.DataType]] = {}
    for f in typed:
        for field in f.schema:
            seen.setdefault(field.name, set()).add(field.dataType)
    as_text = {
        name
        for name, kinds in seen.items()
        if len(kinds) > 1 and not all(_numeric(k) for k in kinds)
    }
    merged = None
    for rank, f in enumerate(typed):
        clash = {c: F.col(c).cast("string") for c in f.columns if c in as_text}
        f = f.withColumns({**clash, STORED_FIRST: F.lit(rank)})
        merged = f if merged is None else merged.unionByName(f, allowMissingColumns=True)
    return merged


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The latest row of every key; nulls in a key are equal, absent key columns are left out.

    ``order_by`` must order the rows of a key totally. Taking row 1 of a ranking lets Spark cut
    every task to one row per key before the shuffle, so many copies of one key cost nothing. A hash of
    the key leads the sort: other keys are told apart by eight bytes, without a look at their rows.
    """
    present = [k for k in keys if k in df.columns]
    if not present:
        return df
    newest = Window.partitionBy(F.xxhash64(*present), *present).orderBy(*[F.desc(c) for c in order_by])
    return (
        df.withColumn("_recency", F.row_number().over(newest))
        .filter(F.col("_recency") == 1)
        .drop("_recency")
    )


def merge_keep_last(
    stored: DataFrame | None, new: DataFrame, order_by: Sequence[str], ds: Dataset = OPTIONS
) -> DataFrame:
    """Stored rows and a new load, the new ones winning; within a load the last one wins."""
    frames = [f for f in (stored, new) if f is not None]
    merged = union_chunks(frames, ds)
    order = [STORED_FIRST, *[c for c in order_by if c in merged.columns]]
    return keep_last(merged, (ds.symbol, *ds.keys), order).drop(STORED_FIRST)
