"""The Parquet lake: scan, upsert, overwrite, purge, compact, changes, status.

Layout below the root, per dataset::

    by_<part>_<buckets>/data/version=<n>/bucket=<b>/period=<yyyymm>/*.parquet
    by_<part>_<buckets>/manifest/write=<n>/*.parquet      one row per symbol of a (version, bucket, period)
    by_<part>_<buckets>/log/snapshot=<n>                  the state after the n-th commit
    by_<part>_<buckets>/rejects/version=<n>/*.parquet     rows that could not be stored, with the reason

A symbol's bucket is a hash of it, so parts number buckets times periods, however many symbols there
are and however often is loaded. A load is added beside what a part holds and reads nothing of it: its
cost does not depend on the history. A read takes the directories of live versions from the manifest and
lists those alone; where several versions of a part hold a symbol's same days, the newest row of a key
counts. ``compact`` folds a part's versions into one.

Writers need no lock. Each takes a version number of its own, writes, and claims the next snapshot by
creating its log file, which fails if it exists. Who loses looks at what the others did: an added load
goes behind theirs as it is; a rewrite (compaction, purge, overwrite) stands where none of the
versions it replaces is gone, and is worked out again from the new state where one is. Readers see a
state as a whole, over all parts at once, and data that is being read is never overwritten. Everything
lives on the file system of the root, reachable by all executors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from strikelake.operators.calendar import date_range
from strikelake.operators.merge import coerce, keep_last
from strikelake.operators.symbols import is_valid_symbol, restrict_symbols
from strikelake.schemas import OPTIONS, PRICES, Dataset, dataset, empty_table

# Key columns of which a symbol's least and greatest value in each file is kept, beside its dates.
ZONES = {"strike": T.DoubleType(), "expiration": T.DateType()}
_FILE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("date_min", T.DateType()),
        T.StructField("date_max", T.DateType()),
        *[T.StructField(f"{c}_{end}", kind) for c, kind in ZONES.items() for end in ("min", "max")],
    ]
)
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("period", T.IntegerType()),
        T.StructField("version", T.LongType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("date_min", T.DateType()),
        T.StructField("date_max", T.DateType()),
        T.StructField("undated", T.LongType()),
        T.StructField("n_files", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("lacks", T.ArrayType(T.StringType())),
        T.StructField("files", T.ArrayType(_FILE)),
    ]
)
_WIDER = {"int": ("bigint", "double"), "float": ("double",)}
_PART = ["bucket", "period"]
_PARTS_DDL = "bucket int, period int, version bigint"
_ARRIVAL, _REASON, _RANK, _APART = "_arrival", "reason", "_rank", "_apart"

Part = tuple[int, int]


class Outdated(Exception):
    """Another writer has replaced what a rewrite started from."""


@dataclass(frozen=True)
class State:
    """A snapshot: where its manifest lies, its versions from old to new, and the batches it holds."""

    number: int = 0
    manifests: tuple[str, ...] = ()
    order: tuple[int, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)

    def record(self) -> str:
        """The text of its log file."""
        return json.dumps(
            {"manifests": self.manifests, "order": self.order, "batches": self.batches, "columns": self.columns}
        )

    def table(self, ds: Dataset) -> Dataset:
        """The dataset with the columns that have become part of it, ahead of ``extras``."""
        own = [T.StructField(c, T.DataType.fromDDL(kind)) for c, kind in self.columns.items()]
        rest = [f for f in ds.schema if f.name not in self.columns]
        at = len(rest) - (rest[-1].name == "extras")
        return replace(ds, schema=T.StructType([*rest[:at], *own, *rest[at:]]))

    def holds(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]


class Lake:
    """A lake under one root path.

    ``part`` is how far option rows are split in time: by ``month``, or by ``year`` for lakes with few
    rows. ``buckets`` is how many groups of symbols there are. Both are fixed for a lake. A part of more
    than ``slice_rows`` rows is written by several tasks. Once a dataset has more than ``fold_after``
    versions, a load ends by compacting the parts that have more than that.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        part: str = "month",
        buckets: int = 16,
        slice_rows: int = 4_000_000,
        fold_after: int = 32,
    ):
        if part not in ("month", "year"):
            raise ValueError(f"unknown part: {part!r}")
        self.spark, self.root = spark, root.rstrip("/")
        self.part, self.buckets, self.slice_rows, self.fold_after = part, buckets, slice_rows, fold_after
        fs, pattern = self._fs(f"{self.root}/*/by_*/log/snapshot=*")
        for found in fs.globStatus(pattern) or []:
            layout = re.search(r"/(by_[^/]+)/log/", str(found.getPath())).group(1)
            if layout != self._layout():
                raise ValueError(f"the lake at {root} is stored {layout.replace('_', ' ')}")

    # --- files ---

    def _layout(self) -> str:
        return f"by_{self.part}_{self.buckets}"

    def _dir(self, ds: Dataset, *parts: str) -> str:
        return "/".join([self.root, ds.name, self._layout(), *parts])

    def _fs(self, path: str):
        hadoop_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return hadoop_path.getFileSystem(conf), hadoop_path

    def _numbers(self, pattern: str) -> list[int]:
        """Numbers in the names that match ``<name>=*``, sorted."""
        fs, path = self._fs(pattern)
        found = fs.globStatus(path) or []
        return sorted(int(re.search(r"=(\d+)(?:/_SUCCESS)?$", str(s.getPath())).group(1)) for s in found)

    def _delete(self, path: str) -> None:
        fs, hadoop_path = self._fs(path)
        fs.delete(hadoop_path, True)

    def read_text(self, path: str) -> str:
        """The text of a small file."""
        fs, hadoop_path = self._fs(path)
        stream = fs.open(hadoop_path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def discard(self, path: str) -> None:
        """Remove a staging folder below the root."""
        if not path.startswith(f"{self.root}/"):
            raise ValueError(f"{path} is not in the lake")
        self._delete(path)

    def _claim(self, path: str, text: str) -> bool:
        """Put a small file at ``path`` unless there is one: whole at once, and for one of several writers.

        The text is written under a name of its own first. On a local disk a hard link then gives it
        the wanted name, on other file systems a rename; both fail where the name is taken.
        """
        jvm = self.spark.sparkContext._jvm
        fs, target = self._fs(path)
        fs.mkdirs(target.getParent())
        draft = target.getParent().suffix(f"/.{target.getName()}.{jvm.java.util.UUID.randomUUID()}")
        out = fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                named = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
                jvm.java.nio.file.Files.createLink(*named)
                return True
            return not fs.exists(target) and bool(fs.rename(draft, target))
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)

    def _take_version(self, ds: Dataset) -> int:
        """A version number that no writer has or had."""
        number = max(self._numbers(self._dir(ds, "claims", "version=*")), default=0)
        while True:
            number += 1
            if self._claim(self._dir(ds, "claims", f"version={number}"), ""):
                return number

    # --- states ---

    def snapshots(self, name: str) -> list[int]:
        """Numbers of the snapshots that can be read."""
        return self._numbers(self._dir(dataset(name), "log", "snapshot=*"))

    def state(self, name: str, snapshot: int | None = None) -> State:
        """A snapshot, the newest unless one is named; number 0 before the first write."""
        ds, known = dataset(name), self.snapshots(name)
        if snapshot == 0 or (snapshot is None and not known):
            return State()
        number = known[-1] if snapshot is None else snapshot
        if number not in known:
            raise ValueError(f"no snapshot {number} of {name}")
        found = json.loads(self.read_text(self._dir(ds, "log", f"snapshot={number}")))
        return State(number, tuple(found["manifests"]), tuple(found["order"]), found["batches"], found["columns"])

    def manifest(self, name: str, snapshot: int | None = None) -> DataFrame:
        """Symbols of the live versions of a dataset's parts; empty before the first write."""
        return self._manifest(dataset(name), self.state(name, snapshot))

    def _manifest(self, ds: Dataset, state: State) -> DataFrame:
        if not state.manifests:
            return empty_table(self.spark, MANIFEST_SCHEMA)
        paths = [self._dir(ds, "manifest", m) for m in state.manifests]
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(*paths)

    def _commit(
        self,
        ds: Dataset,
        read: State,
        version: int,
        gone: Iterable[tuple[int, int, int]] = (),
        batch: tuple[str, int] | None = None,
    ) -> None:
        """Make a written version part of the state, and take ``gone`` (bucket, period, version) out of it.

        ``read`` is the state that the write started from. A version that replaces others ranks behind
        all that it saw and before what came since; an added one ranks last.
        """
        own, gone = f"write={version}", sorted(gone)
        while True:
            head = self.state(ds.name)
            if head.holds(batch):
                return
            manifests, order, attempt = (*head.manifests, own), (*head.order, version), head.number + 1
            if gone or len(head.manifests) >= self.fold_after:
                rows = self._manifest(ds, head)
                if gone:
                    listed = F.broadcast(self.spark.createDataFrame(gone, _PARTS_DDL))
                    if read.number != head.number:
                        still = rows.join(listed, [*_PART, "version"], "left_semi").select(*_PART, "version")
                        if still.distinct().count() < len(gone):
                            raise Outdated(f"{ds.name}: parts of snapshot {read.number} have been replaced")
                    rows = rows.join(listed, [*_PART, "version"], "left_anti")
                kept = f"kept={version}-{attempt}"
                rows.select(*MANIFEST_SCHEMA.names).hint("rebalance").write.mode("overwrite").parquet(
                    self._dir(ds, "manifest", kept)
                )
                alive = {r[0] for r in rows.select("version").distinct().collect()}
                seen = [v for v in head.order if v in read.order] if gone else list(head.order)
                place = 1 + max((head.order.index(v) for v in seen), default=-1)
                order = tuple(v for v in (*head.order[:place], version, *head.order[place:]) if v in alive or v == version)
                manifests = (kept, own)
            batches = head.batches if batch is None else {**head.batches, batch[0]: batch[1]}
            following = replace(head, manifests=manifests, order=order, batches=batches)
            if self._claim(self._dir(ds, "log", f"snapshot={attempt}"), following.record()):
                return

    def _written(self, ds: Dataset, version: int) -> list[str]:
        base = self._dir(ds, "data", f"version={version}")
        fs, pattern = self._fs(f"{base}/bucket=*/period=*")
        return sorted(str(s.getPath()) for s in fs.globStatus(pattern) or [])

    def _note(self, ds: Dataset, version: int, lacks: DataFrame | Column) -> None:
        """Write the manifest rows of a version; of its columns symbol, date, strike and expiration are read.

        Files are counted first, so that a file's size is shared out among its symbols by rows. Each symbol
        keeps its ranges in each of its files, whose number goes with its rows.
        """
        zones = {c: F.col(c) if c in ds.types else F.lit(None).cast(kind) for c, kind in ZONES.items()}
        written = self._read(ds, self._written(ds, version)).select(
            *_PART,
            "version",
            F.col(ds.symbol).alias("symbol"),
            F.col(ds.date).alias("_date"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_size").alias("_size"),
            *[value.alias(c) for c, value in zones.items()],
        )
        per_file = written.groupBy(*_PART, "version", "symbol", "_file", "_size").agg(
            F.count("*").alias("n"),
            F.min("_date").alias("lo"),
            F.max("_date").alias("hi"),
            F.count_if(F.col("_date").isNull()).alias("nulls"),
            *[end(c).alias(f"{c}_{name}") for c in ZONES for name, end in (("min", F.min), ("max", F.max))],
        )
        of_file = F.struct(
            F.regexp_extract("_file", "[^/]+$", 0).alias("name"),
            F.col("n").alias("rows"),
            F.col("lo").alias("date_min"),
            F.col("hi").alias("date_max"),
            *[f"{c}_{end}" for c in ZONES for end in ("min", "max")],
        )
        share = F.col("_size") * F.col("n") / F.sum("n").over(Window.partitionBy("_file"))
        rows = (
            per_file.withColumn("share", share)
            .groupBy(*_PART, "version", "symbol")
            .agg(
                F.sum("n").alias("row_count"),
                F.min("lo").alias("date_min"),
                F.max("hi").alias("date_max"),
                F.sum("nulls").alias("undated"),
                F.count("*").alias("n_files"),
                F.round(F.sum("share")).cast("bigint").alias("size_bytes"),
                F.collect_list(of_file).alias("files"),
            )
        )
        if isinstance(lacks, Column):
            rows = rows.withColumn("lacks", lacks)
        else:
            rows = rows.join(lacks, [*_PART, "symbol"], "left")
        rows.select(*MANIFEST_SCHEMA.names).write.mode("errorifexists").parquet(self._dir(ds, "manifest", f"write={version}"))

    # --- reading ---

    def _read(self, ds: Dataset, paths: list[str]) -> DataFrame:
        partitions = [
            T.StructField("version", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("period", T.IntegerType()),
        ]
        rows = (
            self.spark.read.schema(T.StructType([*ds.schema.fields, *partitions]))
            .option("basePath", self._dir(ds, "data"))
            .parquet(*paths)
        )
        taken = [c for c in ds.schema.names if c not in dataset(ds.name).types]
        if not taken:
            return rows
        # What older loads have of a column that became part of the table is in their extras.
        told = {c: F.coalesce(F.col(c), F.try_element_at("extras", F.lit(c)).try_cast(ds.types[c])) for c in taken}
        left = F.map_filter("extras", lambda k, _: ~k.isin(*taken))
        return rows.withColumns({**told, "extras": F.when(F.size(left) > 0, left)})

    def _path(self, ds: Dataset, bucket: int, period: int, version: int) -> str:
        return self._dir(ds, "data", f"version={version}", f"bucket={bucket}", f"period={period}")

    def _paths(self, ds: Dataset, manifest: DataFrame) -> list[str]:
        """Directories of the manifest's versions of parts."""
        return [self._path(ds, *r) for r in sorted(manifest.select(*_PART, "version").distinct().collect())]

    def _live(self, manifest: DataFrame) -> dict[Part, tuple[tuple[int, ...], bool]]:
        """Per part its versions, and whether a symbol may have one key in several of them.

        That takes days in common: loads that go on where the last one ended need no merge.
        """
        marked = manifest.withColumn("clash", _clash())
        found: dict[Part, tuple[tuple[int, ...], bool]] = {}
        for r in sorted(marked.groupBy(*_PART, "version").agg(F.max("clash").alias("clash")).collect()):
            versions, clash = found.get((r["bucket"], r["period"]), ((), False))
            found[r["bucket"], r["period"]] = (*versions, r["version"]), clash or r["clash"]
        return found

    def _rows(self, ds: Dataset, state: State, parts: dict[Part, tuple[tuple[int, ...], bool]]) -> DataFrame | None:
        """The rows of parts with their ``bucket`` and ``period``, of every key the newest."""
        plain = [self._path(ds, *p, v) for p, (versions, clash) in parts.items() if not clash for v in versions]
        mixed = [(p, v) for p, (versions, clash) in parts.items() if clash for v in versions]
        found = self._read(ds, plain).drop("version") if plain else None
        if mixed:
            used = sorted({v for _, v in mixed}, key=state.order.index)
            rank = F.create_map(*[x for i, v in enumerate(used) for x in (F.lit(v).cast("bigint"), F.lit(i))])
            rows = self._read(ds, [self._path(ds, *p, v) for p, v in mixed])
            ranked = rows.withColumn(_RANK, F.element_at(rank, F.col("version")))
            newest = keep_last(ranked, (ds.symbol, *ds.keys), [_RANK]).drop(_RANK, "version")
            found = newest if found is None else found.unionByName(newest)
        return found

    def scan(
        self,
        name: str,
        symbols: Sequence[str] | None = None,
        date_from: str | None = None,
        date_to: str | None = None,
        snapshot: int | None = None,
    ) -> DataFrame:
        """A dataset, lazily, as of a snapshot; empty with its schema if nothing is stored.

        Symbols and dates choose the directories that are read at all, and reach the row groups of
        their files, which are sorted by symbol and date. Rows move only in parts where loads with
        days in common have not been compacted.
        """
        state = self.state(name, snapshot)
        ds = state.table(dataset(name))
        parts = restrict_symbols(self._manifest(ds, state), symbols)
        if date_from is not None:
            parts = parts.filter(F.col("date_max") >= F.lit(date_from).cast("date"))
        if date_to is not None:
            parts = parts.filter(F.col("date_min") <= F.lit(date_to).cast("date"))
        rows = self._rows(ds, state, self._live(parts))
        if rows is None:
            return empty_table(self.spark, ds.schema)
        rows = restrict_symbols(rows, symbols, ds.symbol)
        return date_range(rows, ds.date, date_from, date_to).select(*ds.schema.names)

    def lookup(self, name: str, symbol: str, snapshot: int | None = None, **ranges: tuple) -> DataFrame:
        """One symbol's rows with key columns in ranges: ``lookup("options", "SPY", strike=(90, 110))``.

        ``ranges`` names the date column, ``strike`` or ``expiration`` with the least and the greatest
        value, either None where that end is open. The ranges that the symbol has in each file decide
        which files are opened; all those columns are part of the key, so a newer row of a key is in none
        of the others. Rows without a value in a column asked for are left out.
        """
        state = self.state(name, snapshot)
        ds = state.table(dataset(name))
        known = {ds.date, *(c for c in ZONES if c in ds.types)}
        if not known.issuperset(ranges):
            raise ValueError(f"no ranges of {sorted(set(ranges) - known)} are kept")
        own = self._manifest(ds, state).filter(F.col("symbol") == symbol.upper())
        files = own.select(*_PART, "version", F.explode("files").alias("f")).select(*_PART, "version", "f.*")
        wanted = F.col(ds.symbol) == symbol.upper()
        for column, (low, high) in ranges.items():
            zone, kind = "date" if column == ds.date else column, ds.types[column]
            wanted &= F.col(column).isNotNull()
            if low is not None:
                files = files.filter(F.col(f"{zone}_max") >= F.lit(low).cast(kind))
                wanted &= F.col(column) >= F.lit(low).cast(kind)
            if high is not None:
                files = files.filter(F.col(f"{zone}_min") <= F.lit(high).cast(kind))
                wanted &= F.col(column) <= F.lit(high).cast(kind)
        found = sorted(files.select(*_PART, "version", "name").collect())
        if not found:
            return empty_table(self.spark, ds.schema)
        rows = self._read(ds, [f"{self._path(ds, *r[:3])}/{r[3]}" for r in found]).filter(wanted)
        if len({r[2] for r in found}) > 1:
            rank = F.create_map(*[x for i, v in enumerate(state.order) for x in (F.lit(v).cast("bigint"), F.lit(i))])
            rows = keep_last(rows.withColumn(_RANK, F.element_at(rank, F.col("version"))), (ds.symbol, *ds.keys), [_RANK])
        return rows.select(*ds.schema.names)

    def symbols(self, name: str) -> DataFrame:
        """Stored symbols in order, from the manifest alone."""
        return self.manifest(name).select("symbol").distinct().orderBy("symbol")

    def _counts(self, ds: Dataset) -> DataFrame:
        """Manifest rows whose ``row_count`` may be added up.

        Where versions have days in common, the keys of the symbols concerned are read and counted.
        """
        state = self.state(ds.name)
        marked = self._manifest(ds, state).withColumn("clash", F.max(_clash()).over(Window.partitionBy(*_PART, "symbol")))
        mixed = sorted(marked.filter("clash").select(*_PART, "version").distinct().collect())
        if not mixed:
            return marked.drop("clash")
        asked = marked.filter("clash").select(*_PART, F.col("symbol").alias(ds.symbol)).distinct()
        keys = [*_PART, ds.symbol, *ds.keys]
        rows = self._read(ds, [self._path(ds, *r) for r in mixed]).join(asked, [*_PART, ds.symbol], "left_semi")
        counted = rows.select(*keys).distinct().groupBy(*_PART, F.col(ds.symbol).alias("symbol"))
        counted = counted.agg(F.count("*").alias("counted")).withColumnsRenamed({"bucket": "_b", "period": "_p", "symbol": "_s"})
        first = F.row_number().over(Window.partitionBy(*_PART, "symbol").orderBy("version")) == 1
        same = (F.col("bucket") == F.col("_b")) & (F.col("period") == F.col("_p")) & (F.col("symbol") == F.col("_s"))
        count = F.when(F.col("clash"), F.when(F.col("first"), F.col("counted")).otherwise(0)).otherwise(F.col("row_count"))
        return marked.withColumn("first", first).join(counted, same, "left").withColumn("row_count", count)

    def status(self) -> DataFrame:
        """Rows, dates, files and bytes per dataset and symbol, from the manifest wherever that tells.

        A file may hold several symbols; each has the share of its bytes that it has of its rows. Files
        and bytes are those on disk, loads that are not compacted yet included.
        """
        per_dataset = [
            self._counts(ds)
            .groupBy("symbol")
            .agg(
                F.sum("row_count").alias("row_count"),
                F.min("date_min").alias("date_min"),
                F.max("date_max").alias("date_max"),
                F.sum("n_files").alias("n_files"),
                F.sum("size_bytes").alias("size_bytes"),
            )
            .select(F.lit(ds.name).alias("dataset"), "*")
            for ds in (OPTIONS, PRICES)
        ]
        return per_dataset[0].unionByName(per_dataset[1])

    def missing_columns(self, name: str) -> DataFrame:
        """Per symbol the table columns that none of its loads brought, from the manifest alone."""
        rows = self.manifest(name).select("symbol", "lacks")
        parts = rows.groupBy("symbol").agg(F.count("*").alias("n_parts"))
        found = rows.select("symbol", F.explode("lacks").alias("column")).groupBy("symbol", "column")
        absent = found.agg(F.count("*").alias("n")).join(parts, "symbol").filter("n = n_parts")
        listed = absent.groupBy("symbol").agg(F.sort_array(F.collect_list("column")).alias("missing"))
        none = F.array().cast("array<string>")
        return parts.join(listed, "symbol", "left").select("symbol", F.coalesce("missing", none).alias("missing"))

    def rejects(self, name: str) -> DataFrame:
        """Rows of all loads that could not be stored, with ``reason``; the symbol is as it came."""
        ds = dataset(name)
        schema = T.StructType([*ds.schema.fields, T.StructField(_REASON, T.StringType())])
        versions = self._numbers(self._dir(ds, "rejects", "version=*", "_SUCCESS"))
        if not versions:
            return empty_table(self.spark, schema)
        return self.spark.read.schema(schema).parquet(*[self._dir(ds, "rejects", f"version={v}") for v in versions])

    # --- changes ---

    def changed_parts(self, name: str, since: int, until: int | None = None) -> tuple[dict, dict]:
        """Parts whose live versions differ between two snapshots: as they were, and as they are."""
        ds = dataset(name)
        old, new = (self._live(self._manifest(ds, self.state(name, n))) for n in (since, until))
        differ = {p for p in old.keys() | new.keys() if old.get(p, ((),))[0] != new.get(p, ((),))[0]}
        return {p: v for p, v in old.items() if p in differ}, {p: v for p, v in new.items() if p in differ}

    def part_rows(self, name: str, parts: dict, snapshot: int | None = None) -> DataFrame:
        """The rows of parts as ``changed_parts`` gives them, with ``bucket`` and ``period``."""
        state = self.state(name, snapshot)
        ds = state.table(dataset(name))
        rows = self._rows(ds, state, parts)
        schema = T.StructType([*ds.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("period", T.IntegerType())])
        return empty_table(self.spark, schema) if rows is None else rows.select(*schema.names)

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """Rows ``inserted``, ``changed`` or ``removed`` between two snapshots, as ``change`` says.

        A changed row has its new values, a removed one its last. Only parts whose versions differ are
        read; their rows meet by key in one exchange. ``since`` 0 is the empty lake.
        """
        ds = self.state(name, until).table(dataset(name))
        old, new = self.changed_parts(name, since, until)
        keys = [ds.symbol, *ds.keys]
        sides = []
        for parts, at, side in ((old, since, "old"), (new, until, "new")):
            # Both sides with the columns of the later one.
            rows = self._rows(ds, self.state(name, at), parts)
            rows = empty_table(self.spark, ds.schema) if rows is None else rows.select(*ds.schema.names)
            if "extras" in ds.types:
                rows = rows.withColumn("extras", F.array_sort(F.map_entries("extras")))
            row = F.struct(*[F.col(c) for c in rows.columns])
            sides.append(rows.select(*keys, *[(row if side == s else F.lit(None).cast(T.StructType(rows.schema.fields))).alias(s) for s in ("old", "new")]))
        met = sides[0].unionByName(sides[1]).groupBy(*keys)
        met = met.agg(F.first("old", ignorenulls=True).alias("old"), F.first("new", ignorenulls=True).alias("new"))
        kind = (
            F.when(F.col("old").isNull(), "inserted")
            .when(F.col("new").isNull(), "removed")
            .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        )
        told = met.select(kind.alias("change"), F.coalesce("new", "old").alias("row")).filter("change IS NOT NULL")
        told = told.select("row.*", "change")
        if "extras" in ds.types:
            told = told.withColumn("extras", F.map_from_entries("extras"))
        return told.select(*ds.schema.names, "change")

    # --- writing ---

    def _conform(self, ds: Dataset, rows: DataFrame, order_by: Sequence[str]) -> DataFrame:
        """Fixed columns and types, the order columns and the place of arrival behind them.

        Columns that the table lacks go into ``extras`` where it has that, columns that the rows
        lack are null. A row without a valid symbol is marked with the reason.
        """
        typed, types = coerce(rows, ds), ds.types
        order = [c for c in order_by if c not in types]
        unknown = [c for c in typed.columns if c not in types and c not in order]
        columns = {c: F.col(c) if c in typed.columns else F.lit(None).cast(types[c]) for c in ds.schema.names}
        if "extras" in types and unknown:
            texts = [x for c in unknown for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
            told = F.create_map(*texts)
            filled = F.map_filter(told, lambda _, v: v.isNotNull())
            if "extras" in typed.columns:
                kept = F.map_filter(columns["extras"], lambda k, _: ~k.isin(unknown))
                both = F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), filled)
                columns["extras"] = F.when(F.size(both) > 0, both)
            else:
                # Rows with a value in every column need no look at each.
                full = reduce(Column.__and__, [c.isNotNull() for c in texts[1::2]])
                columns["extras"] = F.when(full, told).when(F.size(filled) > 0, filled)
        symbol = columns[ds.symbol]
        valid = is_valid_symbol(symbol)
        columns[ds.symbol] = F.when(valid, F.upper(symbol)).otherwise(symbol)
        reason = F.when(symbol.isNull(), "no symbol").when(~valid, "invalid symbol")
        return (
            typed.select(
                *[c.alias(n) for n, c in columns.items()],
                *order,
                reason.alias(_REASON),
                F.monotonically_increasing_id().alias(_ARRIVAL),
            )
            .select("*", *self._place(ds))
        )

    def _stage(
        self, ds: Dataset, rows: DataFrame, order_by: Sequence[str], version: int, staged: bool
    ) -> tuple[DataFrame, DataFrame, int]:
        """What can be stored of a load, the newest row of each of its keys, and how many the former are.

        The load is computed once, and only its newest rows are written, so that many copies of a key cost
        no more than their way to it. Of a stored table nothing is written. The rest goes to the rejects.
        """
        counts = [F.count_if(F.col(_REASON).isNull()).alias("good"), F.count_if(F.col(_REASON).isNotNull()).alias("bad")]
        conformed = self._conform(ds, rows, order_by)
        if not staged:
            path = self._dir(ds, "stage", f"version={version}")
            newest = self._latest(ds, conformed, rows.columns, order_by)
            newest.write.mode("errorifexists").parquet(path)
            conformed = self.spark.read.schema(newest.schema).parquet(path)
        found = conformed.agg(*counts).first().asDict()
        if found["bad"]:
            bad = conformed.filter(F.col(_REASON).isNotNull())
            bad.select(*ds.schema.names, _REASON).write.parquet(self._dir(ds, "rejects", f"version={version}"))
        good = conformed.filter(F.col(_REASON).isNull())
        latest = self._latest(ds, good, rows.columns, order_by) if staged else good
        return good, latest.drop(_REASON), found["good"]

    def _store(self, ds: Dataset, rows: DataFrame, total: int, version: int, counted: DataFrame | None = None) -> None:
        """Write rows as a version: one exchange by part, and by a hash of the key where a part has many rows.

        What a part has is counted in ``counted`` where given: rows that are stored as they are, copies of
        keys included, so that finding the newest of each key is not done once more for the count.
        """
        slices = F.lit(1)
        if total > self.slice_rows:
            # One row per part: buckets times periods at most.
            counted = rows if counted is None else counted
            sizes = [(*r[:2], 1 + r[2] // self.slice_rows) for r in counted.groupBy(*_PART).count().collect()]
            listed = F.broadcast(self.spark.createDataFrame(sizes, "bucket int, period int, slices bigint"))
            rows, slices = rows.join(listed, _PART), F.col("slices")
        placed = rows.withColumn("slice", F.pmod(F.xxhash64(ds.symbol, *ds.keys), slices))
        (
            placed.repartition(*_PART, "slice")
            .sortWithinPartitions(*_PART, ds.symbol, ds.date)
            .select(*ds.schema.names, *_PART)
            .write.mode("errorifexists")
            .partitionBy(*_PART)
            .parquet(self._dir(ds, "data", f"version={version}"))
        )

    def _latest(self, ds: Dataset, new: DataFrame, brought: Sequence[str], order_by: Sequence[str]) -> DataFrame:
        """The newest row of every key of a load, with its part; every row that cannot be stored.

        Only columns that the load brought are moved for it: the others are null, and the part follows
        from the key.
        """
        keys = (ds.symbol, *ds.keys)
        apart = F.when(F.col(_REASON).isNotNull(), F.col(_ARRIVAL)).alias(_APART)
        own = {*brought, *keys, "extras"}
        moved = [c for c in ds.schema.names if c in own]
        order = [*order_by, _ARRIVAL]
        own_order = [c for c in order if c not in moved]
        rows = keep_last(new.select(*moved, *own_order, _REASON, apart), (*keys, _APART), order)
        columns = [F.col(c) if c in own else F.lit(None).cast(ds.types[c]).alias(c) for c in ds.schema.names]
        return rows.select(*columns, _REASON, *self._place(ds))

    def _place(self, ds: Dataset) -> list[Column]:
        """The part of a row."""
        bucket = F.pmod(F.xxhash64(ds.symbol), F.lit(self.buckets)).cast("int")
        return [bucket.alias("bucket"), ds.period(self.part).alias("period")]

    def _load(
        self,
        ds: Dataset,
        rows: DataFrame,
        order_by: Sequence[str],
        replace: bool = False,
        batch: tuple[str, int] | None = None,
        staged: bool = False,
    ) -> None:
        state = self.state(ds.name)
        ds = state.table(ds)
        if state.holds(batch):
            return
        version = self._take_version(ds)
        new, latest, total = self._stage(ds, rows, order_by, version, staged)
        absent = F.array(*[F.lit(c) for c in ds.schema.names if c not in rows.columns and c != "extras"])
        absent = absent.cast("array<string>")
        if total:
            if replace:
                loaded = new.select(F.col(ds.symbol).alias("symbol")).distinct()
                brought = new.select(*_PART, F.col(ds.symbol).alias("symbol")).distinct().withColumn("lacks", absent)
                self._rewrite(ds, lambda m: m.join(loaded, "symbol", "left_semi"), loaded, latest, brought, batch)
            else:
                self._store(ds, latest, total, version, new)
                self._note(ds, version, absent)
                self._commit(ds, state, version, batch=batch)
        elif batch is not None:
            self._commit_batch(ds, batch)
        self._delete(self._dir(ds, "stage", f"version={version}"))
        if total and len(self.state(ds.name).order) > self.fold_after:
            self.compact(ds.name, self.fold_after)

    def _commit_batch(self, ds: Dataset, batch: tuple[str, int]) -> None:
        """Note a batch that brought nothing, so that it is known as done."""
        while True:
            head = self.state(ds.name)
            if head.holds(batch):
                return
            following = replace(head, batches={**head.batches, batch[0]: batch[1]})
            if self._claim(self._dir(ds, "log", f"snapshot={head.number + 1}"), following.record()):
                return

    def promote(self, name: str, column: str, kind: str) -> None:
        """Make a key of ``extras`` a column of the table: ``promote("options", "venue", "string")``.

        Loads from then on store the column as such; rows from before give it from their extras, where
        text that does not fit the type is null. A column can be widened later: int to bigint or double,
        float to double. Only the log changes. Purely textual extras of the same name go into the column.
        """
        ds = dataset(name)
        wanted = T.DataType.fromDDL(kind).simpleString()
        if "extras" not in ds.types or column in ds.types:
            raise ValueError(f"{name} cannot take up a column {column!r}")
        if wanted not in ("string", "date", "boolean", "int", "bigint", "float", "double"):
            raise ValueError(f"{column!r} cannot be {kind}")
        while True:
            head = self.state(name)
            had = head.columns.get(column)
            if had == wanted:
                return
            if had is not None and wanted not in _WIDER.get(had, ()):
                raise ValueError(f"{column!r} is {had} and cannot become {wanted}")
            following = replace(head, columns={**head.columns, column: wanted})
            if self._claim(self._dir(ds, "log", f"snapshot={head.number + 1}"), following.record()):
                return

    def _rewrite(
        self,
        ds: Dataset,
        hit: Callable[[DataFrame], DataFrame],
        doomed: DataFrame | None = None,
        added: DataFrame | None = None,
        brought: DataFrame | None = None,
        batch: tuple[str, int] | None = None,
    ) -> None:
        """Replace the versions of the parts that ``hit`` picks from the manifest by one.

        Symbols in ``doomed`` go, the rows ``added`` come (``brought`` has their lacks). Worked out anew
        while other writers replace the same parts first.
        """
        while True:
            read = self.state(ds.name)
            ds = read.table(dataset(ds.name))
            if read.holds(batch):
                return
            live = self._manifest(ds, read)
            picked = [(r[0], r[1]) for r in hit(live).select(*_PART).distinct().collect()]
            listed = self.spark.createDataFrame(picked, "bucket int, period int") if picked else None
            own = live.join(F.broadcast(listed), _PART, "left_semi") if listed is not None else live.limit(0)
            parts = self._live(own)
            if not parts and added is None:
                return
            rows = self._rows(ds, read, parts)
            told = own.select(*_PART, "symbol", "lacks")
            if doomed is not None:
                told = told.join(doomed, "symbol", "left_anti")
                if rows is not None:
                    rows = rows.join(doomed.withColumnRenamed("symbol", ds.symbol), ds.symbol, "left_anti")
            # Of a symbol's loads into a part, columns that all of them lacked are still lacking.
            common = F.aggregate(F.collect_list("lacks"), F.first("lacks"), lambda a, b: F.array_intersect(a, b))
            lacks = told.groupBy(*_PART, "symbol").agg(common.alias("lacks"))
            if added is not None:
                lacks = lacks.unionByName(brought)
                added = added.withColumns({c: F.lit(None).cast(ds.types[c]) for c in ds.schema.names if c not in added.columns})
                rows = added if rows is None else rows.select(*added.columns).unionByName(added)
            version = self._take_version(ds)
            total = sum(r[0] or 0 for r in own.agg(F.sum("row_count")).collect())
            self._store(ds, rows, total + (self.slice_rows if added is not None else 0), version)
            if self._written(ds, version):
                self._note(ds, version, lacks)
            else:
                empty_table(self.spark, MANIFEST_SCHEMA).write.parquet(self._dir(ds, "manifest", f"write={version}"))
            try:
                self._commit(ds, read, version, [(*p, v) for p, (versions, _) in parts.items() for v in versions], batch)
                return
            except Outdated:
                continue

    def upsert_options(
        self, rows: DataFrame, order_by: Sequence[str], batch: tuple[str, int] | None = None, staged: bool = False
    ) -> None:
        """Merge new option rows into the stored ones; new beat stored, later beat earlier.

        ``order_by`` names the arrival order of the new rows; a null comes before all numbers, and of
        rows that it does not tell apart the one that stands later in ``rows`` wins. The load is
        computed once, unless ``staged`` says that it is a stored table, and put beside what its parts
        hold. Rows without a valid symbol go to :meth:`rejects`. Of several writers at once, the one
        that commits later is the newer. A ``batch`` (name, number) is stored once: with one that the
        lake holds already, of that name and this number or a higher one, nothing happens.
        """
        self._load(OPTIONS, rows, order_by, batch=batch, staged=staged)

    def write_prices(
        self,
        rows: DataFrame,
        order_by: Sequence[str] = (),
        mode: str = "merge",
        batch: tuple[str, int] | None = None,
        staged: bool = False,
    ) -> None:
        """Store price bars per symbol.

        ``overwrite`` replaces all that a loaded symbol had; ``merge`` keeps the days that the
        load lacks, so that a short refresh costs neither the history nor a look at it. One bar per day
        is kept, the last one by ``order_by`` and then by its place in ``rows``. ``batch`` and
        ``staged`` are those of :meth:`upsert_options`.
        """
        if mode not in ("merge", "overwrite"):
            raise ValueError(f"unknown mode: {mode!r}")
        self._load(PRICES, rows, order_by, replace=mode == "overwrite", batch=batch, staged=staged)

    def compact(self, name: str, most: int = 1) -> int:
        """Fold the versions of every part that has more than ``most`` into one; returns how many parts."""
        ds = dataset(name)

        def crowded(manifest: DataFrame) -> DataFrame:
            versions = manifest.groupBy(*_PART).agg(F.count_distinct("version").alias("n"))
            return versions.filter(F.col("n") > most)

        n = crowded(self.manifest(name)).count()
        if n:
            self._rewrite(ds, crowded)
        return n

    def purge(self, requests: DataFrame) -> DataFrame:
        """Drop datasets of symbols. ``requests`` has ``symbol`` and ``dataset``.

        Returns what each request found: rows removed, or a warning when nothing was stored. Parts that
        hold a dropped symbol are written again without it; a dataset that loses nothing stays as it is.
        """
        wanted = requests.select(F.upper("symbol").alias("symbol"), "dataset").distinct()
        outcome = purge_outcome(self.status().select("dataset", "symbol", "row_count"), wanted)
        for ds in (OPTIONS, PRICES):
            doomed = wanted.filter(F.col("dataset") == ds.name).select("symbol")
            self._rewrite(ds, lambda m, doomed=doomed: m.join(doomed, "symbol", "left_semi"), doomed)
        return outcome

    def expire(self, name: str, keep: int = 1) -> int:
        """Remove parts that none of the last ``keep`` snapshots uses and what failed writes left.

        Returns the number of parts removed. Run it when no reader still works on an older snapshot
        and no writer is at work.
        """
        ds = dataset(name)
        snapshots = self.snapshots(name)
        states = [self.state(name, n) for n in snapshots[-keep:]]
        live = {p for s in states for p in self._paths(ds, self._manifest(ds, s))}
        named = {m for s in states for m in s.manifests}
        removed = 0
        for v in self._numbers(self._dir(ds, "data", "version=*")):
            base = self._dir(ds, "data", f"version={v}")
            fs, pattern = self._fs(f"{base}/bucket=*/period=*")
            found = [re.search(r"(bucket=\d+/period=\d+)$", str(s.getPath())).group(1) for s in fs.globStatus(pattern) or []]
            dead = [f for f in found if f"{base}/{f}" not in live]
            for path in [base] if len(dead) == len(found) else [f"{base}/{f}" for f in dead]:
                self._delete(path)
            removed += len(dead)
        for v in self._numbers(self._dir(ds, "stage", "version=*")):
            self._delete(self._dir(ds, "stage", f"version={v}"))
        for n in snapshots[:-keep]:
            self._delete(self._dir(ds, "log", f"snapshot={n}"))
        fs, pattern = self._fs(self._dir(ds, "manifest", "*"))
        for found in fs.globStatus(pattern) or []:
            if found.getPath().getName() not in named:
                self._delete(str(found.getPath()))
        return removed


def _clash() -> Column:
    """Whether an older or equal start of days of the same symbol and part reaches into a version's days."""
    own = Window.partitionBy(*_PART, "symbol")
    before = own.orderBy("date_min", "version").rowsBetween(Window.unboundedPreceding, -1)
    undated = (F.sum((F.col("undated") > 0).cast("int")).over(own) > 1) & (F.col("undated") > 0)
    return F.coalesce(F.max("date_max").over(before) >= F.col("date_min"), F.lit(False)) | undated


def purge_outcome(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: rows that go, and a warning when nothing is stored under it."""
    return requests.join(stored, ["dataset", "symbol"], "left").select(
        "dataset",
        "symbol",
        F.coalesce("row_count", F.lit(0)).alias("rows_removed"),
        F.when(F.col("row_count").isNull(), "nothing stored under this symbol").alias("warning"),
    )


def purge_rows(rows: DataFrame, requests: DataFrame, name: str) -> DataFrame:
    """Rows of a dataset without the symbols that ``requests`` names for it."""
    ds = dataset(name)
    doomed = requests.filter(F.col("dataset") == name).select(F.upper("symbol").alias(ds.symbol))
    return rows.join(doomed, ds.symbol, "left_anti")
