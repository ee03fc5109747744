"""Mixing sources to target weights by Pfair scheduling.

A source of weight w has its j-th block (from 1) released at slot floor((j - 1) / w) and due by slot
ceil(j / w). Taking in each slot the released block with the earliest deadline keeps every source
within less than one block of its weight times the slots so far. Weights are whole shares of a period,
so the schedule repeats: one period is computed once, in SQL, and every block finds its slot by
arithmetic from its number. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strikelake.llm.shared import prefix_sums, store

PERIOD = 1000


def weighted(sizes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """``sizes`` (source, rows) with the weight of each source.

    ``weights`` has (source, weight); without it, weights go with the square root of a source's rows.
    A source without a weight, or with one that is not positive, has 0 and gets the least share.
    """
    if weights is None:
        return sizes.withColumn("weight", F.sqrt("rows"))
    named = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double"))
    wanted = sizes.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return wanted.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))


def quotas(wanted: DataFrame, period: int) -> DataFrame:
    """Blocks per period of each source, at least one and together ``period``, by largest remainder.

    ``wanted`` has (source, members, weight), at most ``period`` rows, so one task does it.
    """
    every = Window.partitionBy()
    by_rest = Window.orderBy(F.desc("rest"), "source")
    share = F.when(F.sum("weight").over(every) > 0, F.col("weight") / F.sum("weight").over(every))
    exact = F.coalesce(share, 1.0 / F.count("*").over(every)) * (period - F.count("*").over(every))
    return (
        wanted.withColumn("exact", exact)
        .withColumn("whole", F.floor("exact"))
        .withColumn("rest", F.round(F.col("exact") - F.col("whole"), 9))
        .withColumn("left", period - F.count("*").over(every) - F.sum("whole").over(every))
        .withColumn("extra", (F.row_number().over(by_rest) <= F.col("left")).cast("bigint"))
        .select("source", "members", (1 + F.col("whole") + F.col("extra")).cast("int").alias("quota"))
    )


def classes(sizes: DataFrame, weights: DataFrame | None, period: int) -> DataFrame:
    """Each source with its ``quota``, ``class``, the class's ``members`` and its ``place`` among them.

    Up to ``period`` sources are classes of their own. Of more sources, those whose weights lie within
    the same eighth of an octave share a class and take its turns one after the other. There are at most
    a fifth of ``period`` such classes (200: down to 2^-25 of the highest weight), the last for all lower ones. A member is then less than one block
    off an equal part of its class's quota, as its class is off the quota.
    """
    wanted, most = weighted(sizes, weights), max(1, period // 5)
    top = wanted.agg(F.max("weight").alias("_top"), F.count("*").alias("_count"))
    step = F.when(F.col("weight") > 0, F.floor(8 * (F.log2("weight") - F.log2("_top"))))
    step = F.greatest(F.coalesce(step, F.lit(1 - most)), F.lit(1 - most)).cast("int")
    alone = F.col("_count") <= period
    own = F.struct(
        F.when(alone, F.lit(0)).otherwise(step).alias("step"), F.when(alone, F.col("source")).alias("only")
    )
    listed = wanted.join(F.broadcast(top)).select("source", "weight", own.alias("class"))
    listed = listed.withColumn("_pile", F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 3))
    # Numbered by piles, as a class may hold most of very many sources.
    piles = listed.groupBy("class", "_pile").agg(F.count("*").alias("_n"), F.sum("weight").alias("_weight"))
    earlier = Window.partitionBy("class").orderBy("_pile").rowsBetween(Window.unboundedPreceding, -1)
    starts = piles.select("class", "_pile", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    totals = piles.groupBy("class").agg(F.sum("_n").alias("members"), F.sum("_weight").alias("weight"))
    shares = quotas(totals.withColumnRenamed("class", "source"), period).withColumnRenamed("source", "class")
    inside = Window.partitionBy("class", "_pile").orderBy("source")
    return (
        listed.withColumn("_r", F.row_number().over(inside) - 1)
        .join(starts, ["class", "_pile"])
        .join(F.broadcast(shares), ["class"])
        .select("source", "class", "members", "quota", (F.col("_start") + F.col("_r")).alias("place"))
    )


def pattern(shares: DataFrame, period: int) -> DataFrame:
    """One row per slot of a period: whose block it is and which of its blocks.

    ``shares`` has (class, quota). The fold walks the slots of one period, at most ``period`` classes,
    whatever the corpus holds.
    """
    listed = shares.agg(F.array_sort(F.collect_list(F.struct("class", "quota"))).alias("s"))
    due = (
        f"struct(((c.n[i] + 1) * {period}L + s[i].quota - 1) div s[i].quota AS due, i AS i)"
    )
    free = f"filter(sequence(0, size(s) - 1), i -> c.n[i] * {period}L div s[i].quota <= t)"
    pick = f"array_min(transform({free}, i -> {due})).i"
    fold = f"""aggregate(
        sequence(0, {period - 1}),
        named_struct('n', array_repeat(0L, size(s)),
                     'slots', cast(array() AS array<struct<i: int, nth: bigint>>)),
        (c, t) -> aggregate(array({pick}), c, (_, i) -> named_struct(
            'n', transform(c.n, (x, k) -> if(k = i, x + 1, x)),
            'slots', array_append(c.slots, named_struct('i', i, 'nth', c.n[i])))),
        c -> c.slots)"""
    return (
        listed.filter(F.size("s") > 0)
        .select("s", F.posexplode(F.expr(fold)).alias("t", "slot"))
        .select(F.expr("s[slot.i].class").alias("of"), F.expr("slot.nth").alias("nth"), "t")
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    block_rows: int = 64,
    period: int = PERIOD,
    seed: int = 42,
    source: str = "source",
) -> DataFrame:
    """All rows with ``block``, ``quota``, ``mix_slot`` and ``position``, the place in the mixed order.

    A source's rows are put in a seeded random order and cut into blocks of ``block_rows``. Every row
    gets a position, gapless from 0. When a source runs out, its slots close up and the others go on
    in the same proportions; up to there each source is less than one block off its quota. No row is
    dropped or repeated.

    Rows without a source are a source of their own. Rows are numbered within (source, first digits
    of a hash of id and text), so a hot source is spread over 4096 tasks and repeated or null ids are
    no trouble; equal rows are numbered in any order. Columns of these names in the input are
    replaced; an empty table gives no rows. There may be any number of sources; of more than
    ``period``, those of like weight share turns, and ``quota`` is what they have together.
    """
    if period < 1:
        raise ValueError("period must be at least 1")
    own = ("block", "quota", "mix_slot", "position")
    kept = [c for c in docs.columns if c not in own]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("record"),
        F.col(source).alias("source"),
        F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1])).alias("digest"),
    ).withColumn("pile", F.substring("digest", 1, 3))
    piles = store(keyed.groupBy("source", "pile").agg(F.count("*").alias("rows")), "mixing-piles")
    sizes = piles.groupBy("source").agg(F.sum("rows").alias("rows"))
    shares = store(classes(sizes, weights, period), "mixing-classes")
    turns = store(pattern(shares.select("class", "quota").distinct(), period), "mixing-turns")
    earlier = Window.partitionBy("source").orderBy("pile").rowsBetween(Window.unboundedPreceding, -1)
    starts = piles.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    starts = starts.withColumn("total", F.sum("rows").over(Window.partitionBy("source")))
    # The blocks that a pile has rows of, listed by the thousand so that no list grows with the corpus.
    last = F.expr(f"(start + rows - 1) div {block_rows}")
    spans = (
        starts.withColumn("low", F.expr(f"start div {block_rows}"))
        .withColumn("high", last)
        .withColumn("from", F.explode(F.expr("sequence(low, high, 1000L)")))
        .withColumn("block", F.explode(F.expr("sequence(from, least(from + 999L, high))")))
    )
    joined = spans.join(
        shares.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))
    ).withColumn("turn", F.expr("block * members + place"))
    placed = joined.join(
        F.broadcast(turns), F.col("class").eqNullSafe(F.col("of")) & (F.expr("turn % quota") == F.col("nth"))
    ).select(
        "source",
        "pile",
        "start",
        "low",
        "block",
        "quota",
        F.expr(f"(turn div quota) * {period}L + t").alias("mix_slot"),
        F.expr(f"least({block_rows}L, total - block * {block_rows}L)").alias("size"),
    )
    placed = store(placed, "mixing-blocks")
    # A block counts once, where it begins.
    whole = placed.filter(f"block * {block_rows}L >= start").select("mix_slot", "size")
    begins = prefix_sums(whole, "mix_slot", "size", "begin").select("mix_slot", "begin")
    at = F.array_sort(F.collect_list(F.struct("block", "mix_slot", "begin"))).alias("at")
    of_pile = (
        placed.join(begins, "mix_slot")
        .groupBy(F.struct("source").alias("of"), "pile")
        .agg(F.first("start").alias("start"), F.first("low").alias("low"), F.first("quota").alias("quota"), at)
    )
    # A struct is never null, so rows without a source meet by plain equality and stay where the window has
    # them: one exchange of whole records serves both.
    in_pile = Window.partitionBy("of", "pile").orderBy("digest", "record.doc_id")
    numbered = (
        keyed.withColumn("of", F.struct("source"))
        .withColumn("r", F.row_number().over(in_pile) - 1)
        .join(of_pile.hint("merge"), ["of", "pile"])
        .withColumn("n", F.col("r") + F.col("start"))
        .withColumn("block", F.expr(f"n div {block_rows}"))
        .withColumn("of_block", F.expr("at[cast(block - low AS int)]"))
    )
    return numbered.select(
        *[F.col("record").getField(c).alias(c) for c in kept],
        F.col("block").cast("bigint").alias("block"),
        F.col("quota").cast("int").alias("quota"),
        F.col("of_block.mix_slot").alias("mix_slot"),
        F.expr(f"of_block.begin + n % {block_rows}").alias("position"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Sorted by position over all partitions, so that written files hold the rows in mixed order."""
    return mixed.orderBy("position")
