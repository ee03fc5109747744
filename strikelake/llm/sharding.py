"""Sharding: a uniform random order of all records, cut into shards of near equal row counts.

Two passes. The first numbers each record, gives it a bucket by a seeded hash and writes both to the
shared folder, which fixes the draw for good. The second brings a bucket to one task in the order of those
numbers, permutes it (Spark's ``shuffle`` is a Fisher-Yates shuffle with a seed, and starts anew in
each task, whose buckets come in order) and reads off each record's place in the whole order: rows of
earlier buckets plus its place in its own. A task that is run again so gives the same places. A shard is a range of that order, so
a bucket's task writes straight into one or two shards. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strikelake.llm.shared import prefix_sums, store


def shuffle_shards(
    docs: DataFrame, n_shards: int, *, seed: int = 42, bucket_bytes: int = 8 << 20, text: str = "text"
) -> DataFrame:
    """All rows with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Row counts of shards are at most one apart; with fewer rows than shards some are empty. The hash
    takes the row's number in the scan and nothing of its content: equal rows, null ids and hot
    sources spread like any other, and a bucket holds ``bucket_bytes`` of text on average. A null text
    counts no bytes. Columns ``shard`` and ``slot`` of the input are replaced; an empty table gives
    no rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    figures = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    total, n_buckets = figures["n"], 1 + ((figures["b"] or 0) + 64 * figures["n"]) // bucket_bytes
    record = F.struct(*[F.col(f"`{c}`") for c in kept])
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), record.alias("_record"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(n_buckets))
    scattered = store(numbered.select("_row", draw.alias("_bucket"), "_record"), "scatter")
    sizes = scattered.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    starts = prefix_sums(sizes, "_bucket", "_rows", "_first").select("_bucket", "_first")
    # In the order of the numbers, in whatever order the blocks of the exchange arrive.
    found = F.collect_list(F.struct("_row", "_record")).alias("_found")
    place = F.sort_array(F.transform("_found", lambda x, i: F.struct(x["_row"].alias("row"), i.alias("i"))))
    piles = scattered.groupBy("_bucket").agg(found).withColumn("_places", place).sortWithinPartitions("_bucket")
    record_at = F.transform("_places", lambda p: F.get("_found", p["i"])["_record"])
    piles = piles.withColumn("_pile", record_at).select("_bucket", F.shuffle("_pile", seed).alias("_pile"))
    # Whole numbers throughout, so that no shard is off by rounding.
    place = F.col("_first") + F.col("_at")
    shard = F.expr(f"(_first + _at) * {n_shards}L div {max(total, 1)}L")
    first = F.expr(f"(_shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return (
        piles.join(starts, "_bucket")
        .select("_first", F.posexplode("_pile").alias("_at", "_record"))
        .withColumn("_shard", shard)
        .select(
            *[F.col("_record").getField(c).alias(c) for c in kept],
            F.col("_shard").cast("int").alias("shard"),
            (place - first).cast("bigint").alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard below ``path``, rows by slot in each of its files."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
