"""The quality report of a lake, kept up to date from what loads change.

The report follows from day profiles, one row per symbol and day, and each of those lies in one part of
the lake. They are stored with the snapshots they were made from; a refresh profiles the parts whose
versions have changed since, takes the other days over, and never reads the rest of the lake. Stored rows
differ in their keys, so there are no duplicates to count.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from strikelake.operators import daily
from strikelake.plans.quality import report_of, symbol_facts
from strikelake.schemas import OPTIONS, PRICES, empty_table
from strikelake.sources.lake import Lake

_PART = ["bucket", "period"]
_PROFILES = {OPTIONS.name: daily.options_daily, PRICES.name: daily.prices_daily}


class QualityState:
    """Day profiles of a lake, below its root.

    Each refresh writes new tables and then claims the next state; of two at once one is the next and
    the other's tables are left unused.
    """

    def __init__(self, lake: Lake):
        self.lake, self.root = lake, f"{lake.root}/quality"

    def _states(self) -> list[int]:
        return self.lake._numbers(f"{self.root}/state=*")

    def _record(self) -> dict:
        """Where the profiles lie and the snapshots they are of."""
        states = self._states()
        if not states:
            return {"tables": {}, "snapshots": {}}
        return json.loads(self.lake.read_text(f"{self.root}/state={states[-1]}"))

    def _profiles(self, name: str, record: dict) -> DataFrame:
        ds = OPTIONS if name == OPTIONS.name else PRICES
        parts = [T.StructField(c, T.IntegerType()) for c in _PART]
        rows = empty_table(self.lake.spark, T.StructType([*ds.schema.fields, *parts]))
        empty = _PROFILES[name](rows, _PART)
        path = record["tables"].get(name)
        return empty.limit(0) if path is None else self.lake.spark.read.schema(empty.schema).parquet(path)

    def stale(self, name: str, record: dict | None = None) -> tuple[list[tuple[int, int]], dict, int]:
        """Parts whose profiles are out of date, what those hold now, and the snapshot that this is.

        A state of a snapshot that has expired is of no use: every part counts as changed.
        """
        record, lake = record or self._record(), self.lake
        now, before = lake.state(name).number, record["snapshots"].get(name, 0)
        if before and before not in lake.snapshots(name):
            before = 0
        old, new = lake.changed_parts(name, before, now)
        return sorted(old.keys() | new.keys()), new, now

    def refresh(self) -> int:
        """Bring the profiles up to the newest snapshots; returns how many parts had to be read."""
        record = self._record()
        tables, snapshots, read = dict(record["tables"]), dict(record["snapshots"]), 0
        for name, profile in _PROFILES.items():
            parts, new, now = self.stale(name, record)
            whole = snapshots.get(name, 0) not in (0, *self.lake.snapshots(name))
            snapshots[name] = now
            if not parts and not whole:
                continue
            kept = self._profiles(name, record)
            if whole:
                kept = kept.limit(0)
            elif parts:
                listed = self.lake.spark.createDataFrame(parts, "bucket int, period int")
                kept = kept.join(F.broadcast(listed), _PART, "left_anti")
            found = kept
            if new:
                found = kept.unionByName(profile(self.lake.part_rows(name, new, now), _PART))
            tables[name] = f"{self.root}/{name}/{uuid.uuid4().hex}"
            found.write.parquet(tables[name])
            read += len(new)
        if snapshots != record["snapshots"]:
            number = max(self._states(), default=0) + 1
            self.lake._claim(f"{self.root}/state={number}", json.dumps({"tables": tables, "snapshots": snapshots}))
        return read

    def report(self) -> DataFrame:
        """All checks of all symbols, as :func:`strikelake.plans.quality.quality_report` gives them."""
        record, spark = self._record(), self.lake.spark
        days = [self._profiles(name, record).drop(*_PART) for name in (OPTIONS.name, PRICES.name)]
        per_symbol = symbol_facts(*days).withColumn("duplicate_rows", F.lit(0).cast("bigint"))
        return report_of(per_symbol, empty_table(spark, OPTIONS.schema), empty_table(spark, PRICES.schema))


def quality_report_incremental(lake: Lake) -> DataFrame:
    """The report of a lake's newest state, at the cost of what changed since the last one."""
    state = QualityState(lake)
    state.refresh()
    return state.report()
