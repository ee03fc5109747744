"""What keeps the training-data operators within disk and memory at any size."""

from __future__ import annotations

import hashlib
import os
import tracemalloc

import numpy as np

import corpus_pipeline
from strikelake.llm import bpe, exact, mixing, setsketch, shared
from strikelake.llm.repeats import RunIndex

DOC = "doc_id bigint, text string, source string"


def _documents(spark, n=60):
    texts = [" ".join(f"w{(i // 3) * 7 + j}" for j in range(40)) + ("" if i % 3 else " more") for i in range(n)]
    return spark.createDataFrame([(i, t, (None, "web", "code")[i % 4 % 3]) for i, t in enumerate(texts)], DOC)


def test_mixing_moves_whole_records_once(spark):
    """pipeline: rows stay where their window has them when their blocks' places are joined."""
    mixed = mixing.mix(_documents(spark))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    ahead = plan[: plan.index("Window [row_number()")]
    assert "SortMergeJoin" in ahead and "Exchange" not in ahead
    assert sorted(r["position"] for r in mixed.collect()) == list(range(60))


def test_dropping_copies_leaves_only_what_its_result_reads(spark):
    """pipeline: tables of a stage that nothing reads any more do not count beside the next one's."""
    root, docs = spark.conf.get("spark.checkpoint.dir"), _documents(spark)
    for drop, kept, left in (
        (exact.drop_copies, 40, {"radix-rows", "radix-dropped"}),
        (setsketch.drop_near, 20, {"near-rows", "near-dropped"}),
    ):
        before = set(os.listdir(root))
        result = drop(docs)
        assert {x.rpartition("-")[0] for x in set(os.listdir(root)) - before} == left
        assert result.count() == kept


def test_an_index_takes_little_memory_beside_its_text():
    """op3_repeats: two tasks and their Python workers share an executor."""
    draw = np.random.default_rng(1)
    base = draw.integers(97, 123, 700).astype(np.uint8)
    copies = np.tile(base, (600, 1))
    copies[np.arange(600), draw.integers(0, 700, 600)] = 33
    tracemalloc.start()
    found = RunIndex(copies.ravel(), np.arange(1, 601) * 700).statistics()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found.reshape(600, 700).max(1) >= 350).all()
    assert peak < 75 * copies.size


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _stored(monkeypatch, module, spark):
    """What ``module`` stores from now on: (plan, bytes of an Arrow batch)."""
    seen = []

    def noted(df, label, lasting=False):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((plan, int(spark.conf.get(BATCH).rstrip("b"))))
        return shared.store(df, label, lasting)

    monkeypatch.setattr(module, "store", noted)
    return seen


def test_a_task_of_encoding_has_one_python_worker_at_a_time(spark, monkeypatch):
    """F1, pipeline: workers of encoding and decoding side by side took what the executor had left."""
    before, seen = spark.conf.get(BATCH), _stored(monkeypatch, corpus_pipeline, spark)
    docs = _documents(spark)
    rows = corpus_pipeline.encode(spark, docs, "").collect()
    assert [r["position"] for r in rows] == list(range(60))
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {
        d["doc_id"]: hashlib.sha256(d["text"].encode()).hexdigest() for d in docs.collect()
    }
    assert [plan.split("Initial Plan")[0].count("MapInArrow") for plan, _ in seen] == [1, 1]
    assert all(size <= 2 << 20 for _, size in seen)
    assert spark.conf.get(BATCH) == before


def test_near_dedup_reads_small_batches(spark, monkeypatch):
    """F1, pipeline: batches of 10,000 whole texts stayed with executors and workers."""
    before, seen = spark.conf.get(BATCH), _stored(monkeypatch, setsketch, spark)
    assert setsketch.drop_near(_documents(spark)).count() == 20
    python = [size for plan, size in seen if "MapInArrow" in plan]
    assert len(python) > 2 and all(size <= 2 << 20 for size in python)
    assert spark.conf.get(BATCH) == before


def test_an_encoder_holds_a_word_of_its_texts_once():
    """F1, pipeline: each word of a batch was a string of its own wherever it stood."""
    tokens = [bytes([b]) for b in range(256)] + [b" w", b" w1"]
    encoder = bpe.Encoder(bpe.Merges(tokens), r" ?\w+|\s+")
    texts = [" ".join(f"w{(i + j) % 50}" for j in range(5000)) for i in range(100)]
    tracemalloc.start()
    ids = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for text, coded in zip(texts, ids, strict=True):
        assert b"".join(tokens[i] for i in np.frombuffer(coded, "<u4")) == text.encode()
    assert peak < 16e6
