"""From raw documents to token ids: filter by quality, drop copies and near-copies, mix sources, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and hands what it reads back to the next. Null columns, empty and long texts,
repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.llm import bpe, exact, mixing, quality, setsketch
from strikelake.llm.shared import passing, small_batches, store

#: A model's verdict is no matter for SQL; tests hold the stages against brute force.
ORACLE_SQL = None
LEAST_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more, learned from all quality labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels)
    return docs.filter(quality.scorer(docs, model) >= LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of their five-word shingles, the document with the smallest id."""
    return setsketch.drop_near(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted into the mixed order of their sources; ``encode`` tells each one's place."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of the ids and of the text they decode to, and each document's mixed place.

    Files do not keep the order of rows when they are read, so ``mix_slot`` and ``position`` are worked
    out from the documents again, which gives the same places whatever order they come in. The rows
    are sorted by ``position``; it stands in a column for readers of files written from them.
    """
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    placed = mixing.mix(docs.select("doc_id", "source", "text")).drop("block", "quota")
    with passing(spark), small_batches(spark):
        # Ids are stored, so that a task has one Python worker at a time, and encoding's memory is back for decoding.
        encoded = store(bpe.encode(placed, tokens, public_tokenizers.PATTERN).drop("text"), "pipeline-ids")
        digests = bpe.decode(encoded, tokens).select(
            "doc_id",
            "source",
            "mix_slot",
            "position",
            F.expr("octet_length(ids) div 4").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2("decoded", 256).alias("decoded_sha256"),
        )
        # Sorting looks at its input twice, so the texts are encoded once and only the digests sorted.
        digests = store(digests, "pipeline-digests", lasting=True)
    return mixing.in_order(digests)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
