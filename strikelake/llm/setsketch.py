"""Near-duplicate groups by SetSketch registers.

A document is its set of word shingles. Each of the sketch's registers holds the smallest of the set's
exponential hashes on an exponentially spaced, truncated scale, so sketches of parts merge by maxima
and equal registers come up about as often as sets are alike. Registers are banded: documents that agree
on a band are candidates. A pair's similarity is then estimated from which registers are larger, equal
and smaller, by maximum likelihood with both set sizes known; pairs that are clearly apart go, and the
rest is confirmed on full shingle sets.

With 32 bands of 4 registers a pair at a similarity of 0.8 is missed with a chance of 5e-8, and the
estimate drops it with one of about 3e-7. Nothing is capped. Equal sets are one class from the start. A
bucket first compares its members with one leader each, and only while they are in different
components: a number of pairs in proportion to its rows. New leaders are the documents with the most
shingles that others have, to which a large group of near copies links at once. What is then still apart is bounded exactly: each member is described by what it lacks of its
leader and has beyond it, two members can only be linked if they share enough of these differences,
and differences that no other document has cannot be shared. The few pairs for which that leaves room
are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strikelake.llm.components import components
from strikelake.llm.shared import give_back, passing, slices, small_batches, store
from strikelake.llm.words import Hasher, mix, shingles, spans

BASE, RATE, TOP = 1.001, 20.0, 65535
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
ROUNDS = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets(column: pa.Array, k: int):
    """Per row of a text column its sorted distinct shingles of A-Z-lowered words, as 64-bit hashes."""
    hasher = Hasher()
    for lo, data, offsets in slices(column):
        data = _LOWER[data]
        starts, ends, rows = spans(data, offsets)
        hashes = hasher.ranges(data, starts, ends)
        yield lo, shingles(hashes, rows, len(offsets) - 1, k)


def registers(found: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; an empty set has zeros."""
    out = np.zeros((len(found), REGISTERS), np.uint16)
    full = np.array([i for i, s in enumerate(found) if len(s)], np.int64)
    if not len(full):
        return out
    draw = np.random.default_rng(7)
    factor = draw.integers(0, 1 << 64, REGISTERS, np.uint64) | np.uint64(1)
    flip = draw.integers(0, 1 << 64, REGISTERS, np.uint64)
    values = np.concatenate([found[i] for i in full])
    at = np.concatenate([[0], np.cumsum([len(found[i]) for i in full])[:-1]])
    least = np.empty((REGISTERS, len(full)), np.uint64)
    buffer = np.empty_like(values)
    for j in range(REGISTERS):
        np.bitwise_xor(values, flip[j], out=buffer)
        np.multiply(buffer, factor[j], out=buffer)
        least[j] = np.minimum.reduceat(buffer, at)
    h = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    scale = np.floor(1 - np.log(np.maximum(h, 1e-300)) / np.log(BASE))
    out[full] = np.clip(scale, 0, TOP).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its four registers and its number, mixed."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    return mix(packed ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :]
    j = np.minimum(grid, np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    odds = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(j, odds.argmax(1)[:, None], 1)[:, 0]


def _sketches(rows: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, found in sets(batch.column("_text"), k):
                regs = registers(found)
                keys = band_keys(regs)
                part = batch.slice(lo, len(found))
                total = [s.sum(dtype=np.uint64) for s in found]
                folded = [np.bitwise_xor.reduce(mix(s + np.uint64(11))) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_row"),
                        part.column("_id"),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array(np.array(total, np.uint64).view(np.int64)),
                        pa.array(np.array(folded, np.uint64).view(np.int64)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(
                            pa.list_(pa.int64())
                        ),
                    ],
                    names=["_row", "_id", "n", "set_a", "set_b", "regs", "bands"],
                )
            del batch
        give_back()

    ident = rows.schema["_id"].dataType.simpleString()
    return rows.select("_row", "_id", "_text").mapInArrow(
        run, f"_row bigint, _id {ident}, n bigint, set_a bigint, set_b bigint, regs binary, bands array<bigint>"
    )


def _full_sets(rows: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, found in sets(batch.column("_text"), k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(lo, len(found)), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["_row", "set"],
                )
            del batch
        give_back()

    return rows.select("_row", "_text").mapInArrow(run, "_row bigint, set binary")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sizes and sketches leave a similarity of ``percent`` possible."""
    limit = percent / 100

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for c in ("u_regs", "v_regs")
            )
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("u_n", "v_n"))
            j = estimate(a, b, n_a, n_b)
            spread = 5 * np.sqrt(np.maximum(limit * (1 - limit), j * (1 - j)) / REGISTERS)
            yield batch.select(["u", "v"]).filter(pa.array(j + spread >= limit))

    sized = f"100 * least(u_n, v_n) >= {percent} * greatest(u_n, v_n)"
    return pairs.filter(sized).mapInArrow(run, "u bigint, v bigint")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("u_set").to_pylist(), batch.column("v_set").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "u bigint, v bigint")


def _joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The pairs with columns of both their rows."""
    for side in ("u", "v"):
        named = table.select(F.col("rep").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        pairs = pairs.join(named, side)
    return pairs


def _with_leaders(buckets: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the bucket's leader and its component.

    The leader is the document with the most shingles that others have, less those of its own: the text
    that a group was copied from, rather than a changed or a shortened copy. Before those are counted
    (``own`` is null) it is any.
    """
    order = F.struct((2 * F.col("own") - F.col("n")).alias("less"), F.xxhash64("rep").alias("h"), "rep", "comp")
    leaders = buckets.groupBy("key").agg(
        F.min(order).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    leaders = leaders.filter("lo < hi").select("key", F.col("lead.rep").alias("lead"), F.col("lead.comp").alias("lead_comp"))
    return store(buckets.join(store(leaders, "near-leaders"), "key"), "near-buckets")


def _leader_pairs(led: DataFrame) -> DataFrame:
    """Each row with its bucket's leader, where they are in different components."""
    met = led.filter("comp <> lead_comp")
    return met.select(F.least("rep", "lead").alias("u"), F.greatest("rep", "lead").alias("v")).distinct()


def _own_shingles(buckets: DataFrame, full: DataFrame) -> DataFrame:
    """(rep, own, alone): how many of its shingles no other document of the buckets has, and which."""

    def run(batches):
        for batch in batches:
            sets_ = batch.column("set").to_pylist()
            sizes = [len(x) // 8 for x in sets_]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("rep").to_numpy(), sizes)),
                    pa.array(np.frombuffer(b"".join(sets_), np.int64)),
                ],
                names=["rep", "shingle"],
            )

    members = buckets.select("rep").distinct()
    each = full.join(members, "rep").select("rep", "set").mapInArrow(run, "rep bigint, shingle bigint")
    alone = each.groupBy("shingle").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).filter("c = 1")
    # At most the document's own set.
    return store(alone.groupBy("rep").agg(F.count("*").alias("own"), F.collect_list("shingle").alias("alone")), "near-own")


def _against_leaders(led: DataFrame, full: DataFrame) -> DataFrame:
    """(rep, lead, l, common): size of each bucket's leader and what its members have in common with it."""

    def run(batches):
        for batch in batches:
            size, common = [], []
            for x, y in zip(batch.column("u_set").to_pylist(), batch.column("v_set").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size.append(len(y))
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), pa.array(size, pa.int64()), pa.array(common, pa.int64())],
                names=["rep", "lead", "l", "common"],
            )

    pairs = led.filter("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct()
    return _joined(pairs, full, "set").mapInArrow(run, "rep bigint, lead bigint, l bigint, common bigint")


def _difference_tokens(members: DataFrame, full: DataFrame, own: DataFrame) -> DataFrame:
    """The first ``prefix`` of what each member has beyond its leader or lacks of it, added ones first."""

    def run(batches):
        for batch in batches:
            at, tokens, places = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("set", "lead_set", "alone", "prefix")]
            for i, (x, y, alone, n) in enumerate(zip(*columns, strict=True)):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                shared = np.setdiff1d(x, np.array(alone or [], np.int64), assume_unique=True)
                added = np.sort(np.setdiff1d(shared, y, assume_unique=True))
                found = np.concatenate([added, np.sort(np.setdiff1d(y, x, assume_unique=True))])[:n]
                at.append(np.full(len(found), i))
                tokens.append(found)
                places.append(np.arange(len(found)))
            at, tokens, places = (pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (at, tokens, places))
            kept = [batch.column(c).take(at) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, tokens, places], names=[*names, "token", "place"])

    names = ["rep", "lead", "n", "m", "comp", "s", "w", "e"]
    sets_ = full.select(F.col("rep").alias("lead"), F.col("set").alias("lead_set"))
    met = members.join(full, "rep").join(sets_, "lead").join(own.select("rep", "alone"), "rep", "left")
    return met.select(*names, "prefix", "set", "lead_set", "alone").mapInArrow(
        run, ", ".join(f"{c} bigint" for c in [*names, "token", "place"])
    )


def _last_pairs(led: DataFrame, full: DataFrame, own: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of leaders, and pairs of a bucket in different components that can still be linked.

    A member lacks r of its leader's l shingles and has a others. Two members share c of these
    differences, and with t as the limit they are linked just if (1 + t) c >= w + w' - (1 - t) l, where
    w = r + t a. Differences that are a document's own cannot be shared, so c is at most s = r + a - own
    of either. Members within the limit of the leader are linked to it already; each of the others,
    with an excess e = w - (1 - t) l above 0, needs a partner whose slack (1 + t) s - w is no less.

    As w is at least t c, an excess asks for c >= e, and of a linked member's partner, which has one,
    for (1 + t) c >= w + e. So of two linked documents' s differences each, in whatever common order, one
    is among the first s - c + 1 of both: pairs meet there, and only where enough differences can follow
    if this is the first that they share. Added ones stand first, since in a group of copies it is what
    was taken out that many have in common.
    """
    near = store(_against_leaders(led, full), "near-to-leaders")
    mine = (
        led.select("rep", "n", "own", "comp", "lead", "lead_comp")
        .distinct()
        .join(near, ["rep", "lead"])
        .withColumn("own", F.coalesce("own", F.lit(0)))
        .withColumn("s", F.expr("l + n - 2 * common - own"))
        .withColumn("w", F.expr(f"100 * (l - common) + {percent} * (n - common)"))
        .withColumn("e", F.expr(f"w - {100 - percent} * l"))
        .withColumn("slack", F.expr(f"{100 + percent} * s - w"))
        .withColumn("m", F.expr("n - own"))
    )
    mine = store(mine, "near-differences")
    linked = mine.filter("e <= 0 AND comp <> lead_comp")
    links = linked.select(F.least("rep", "lead").alias("u"), F.greatest("rep", "lead").alias("v")).distinct()
    usable = mine.filter(f"100 * m >= {percent} * n")
    most = usable.groupBy("lead").agg(F.max("slack").alias("most"))
    least = usable.filter("e > 0").join(most, "lead").filter("e <= most").groupBy("lead").agg(F.min("e").alias("least"))
    fewest = F.expr(f"if(e > 0, ceil(e / 100), ceil((w + least) / {100 + percent}))")
    kept = (
        usable.join(least, "lead")
        .filter("slack >= least OR e > 0")
        .withColumn("prefix", F.expr("s + 1") - F.greatest(fewest, F.lit(1)))
        .filter("prefix > 0")
    )
    tokens = store(_difference_tokens(kept, full, own), "near-tokens")
    other = {c: f"{c}_b" for c in ("rep", "n", "m", "comp", "s", "w", "e", "place")}
    met = tokens.filter("e > 0").join(tokens.withColumnsRenamed(other), ["lead", "token"]).filter(
        f"comp <> comp_b AND {100 + percent} * least(s - place, s_b - place_b) >= w + e_b"
        f" AND 100 * least(m, m_b) >= {percent} * (n + n_b - least(m, m_b))"
    )
    return links, met.select(F.least("rep", "rep_b").alias("u"), F.greatest("rep", "rep_b").alias("v")).distinct()


def _classes(rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sketches, and per distinct set its (set_a, set_b) with the first row of its component."""
    sketches = store(_sketches(rows, k), "near-sketches")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    distinct = sketches.filter("n > 0").groupBy("set_a", "set_b")
    reps = store(
        distinct.agg(
            F.min("_row").alias("rep"), first.alias("first"), F.first("n").alias("n"),
            F.first("regs").alias("regs"), F.first("bands").alias("bands"),
        ),
        "near-classes",
    )
    banded = reps.select("rep", F.explode("bands").alias("key"))
    shared = store(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "near-shared")
    sized = reps.select("rep", "n", F.lit(None).cast("bigint").alias("own"), F.explode("bands").alias("key"))
    buckets = store(sized.join(shared, "key").withColumn("comp", F.col("rep")), "near-buckets")
    members = buckets.select(F.col("rep").alias("_row")).distinct()
    full = store(_full_sets(rows.join(members, "_row"), k).withColumnRenamed("_row", "rep"), "near-sets")
    links = roots = None
    for turn in range(ROUNDS + 1):
        if turn:
            buckets = led.drop("lead", "lead_comp")
        if turn == 1:
            own = _own_shingles(buckets, full)
            buckets = buckets.drop("own").join(own.select("rep", "own"), "rep", "left").fillna(0, ["own"])
        if turn and roots is not None:
            named = roots.select(F.col("node").alias("rep"), "root")
            buckets = buckets.drop("comp").join(named, "rep", "left")
            buckets = buckets.withColumn("comp", F.coalesce("root", "rep")).drop("root")
        led = _with_leaders(store(buckets, "near-buckets") if turn else buckets)
        if turn < ROUNDS:
            likely = _likely(_joined(_leader_pairs(led), reps, "n", "regs"), percent)
            found = _confirmed(_joined(likely, full, "set"), percent)
        else:  # what the bounds leave is all but likely
            direct, pairs = _last_pairs(led, full, own, percent)
            found = _confirmed(_joined(pairs, full, "set"), percent).unionByName(direct)
        found = store(found, "near-links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            if turn < ROUNDS:  # a root here only tells which pairs need no comparison
                roots = components(links, rounds=1)
    if links is None:
        return sketches, reps.select("set_a", "set_b", "first")
    named = components(links).select(F.col("node").alias("rep"), "root")
    placed = (
        reps.select("rep", "set_a", "set_b", "first").join(named, "rep", "left")
        .select("set_a", "set_b", "first", F.coalesce("root", "rep").alias("comp"))
    )
    firsts = store(placed.groupBy("comp").agg(F.min("first").alias("first")), "near-firsts")
    return sketches, store(placed.drop("first").join(firsts, "comp").select("set_a", "set_b", "first"), "near-first")


def _grouped(rows: DataFrame, k: int, percent: int) -> DataFrame:
    with small_batches(rows.sparkSession):
        sketches, classes = _classes(rows, k, percent)
    return sketches.select("_row", "_id", "n", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left").select(
        "_row",
        "_id",
        "n",
        F.when(F.col("first").isNull(), F.col("_id")).otherwise(F.col("first.id")).alias("component"),
        F.coalesce(F.col("first.row") == F.col("_row"), F.lit(True)).alias("stays"),
    )


def near_groups(
    docs: DataFrame, *, words: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: id, ``n_shingles``, ``component_id``, ``kept``.

    Rows are linked when 100 * intersection >= percent * union of their shingle sets, and a component is
    all that links reach; ``component_id`` is its smallest id, kept the row with that id (of several
    with the same id, one; a row without an id comes after those with one). A text of fewer words is
    one shingle; a null, empty or blank text has none and stays by itself. Whole texts are used. No
    rows give no rows.
    """
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).alias("_text"))
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    return _grouped(rows, words, percent).select(
        F.col("_id").alias(ident),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("stays").alias("kept"),
    )


def drop_near(
    docs: DataFrame, *, words: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows that ``near_groups`` keeps, with all their columns, whatever those are called."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_record")
    rows = store(docs.select(record, F.monotonically_increasing_id().alias("_row")), "near-rows")
    field = F.col("_record").getField
    named = rows.select("_row", field(ident).alias("_id"), field(text).alias("_text"))
    with passing(docs.sparkSession):
        dropped = _grouped(named, words, percent).filter("NOT stays").select("_row")
        dropped = store(dropped, "near-dropped", lasting=True)
    return rows.join(dropped, "_row", "left_anti").select("_record.*")
