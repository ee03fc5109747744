"""The registered queries on the small table, against their SQL or held-out labels, and the pipeline."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strikelake.llm import mixing, queries, shared

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SMALL = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(
        map(repr, (tuple(r[i] for i in order) for r in want.fetchall()))
    )


@pytest.mark.parametrize("name,label", [("op7_toxicity", "toxic"), ("op8_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = queries.QUERIES[name](spark, SMALL).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r[label] for r in rows)
    assert right >= 0.9 * len(rows)


def test_held_out_languages(spark):
    docs = queries.documents(spark, SMALL).select("doc_id", "lang")
    rows = queries.QUERIES["op5_language_id"](spark, SMALL).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_every_operator_has_a_query_over_all_rows(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    total = queries.documents(spark, SF).count()
    for name in ("op1_sharding", "op2_bpe", "op9_quality_rules"):
        assert queries.QUERIES[name](spark, SF).count() == total


def test_no_python_on_the_native_paths(spark):
    for name in ("op1_sharding", "op10_mixing"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.store(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    texts = [r.text for r in docs.select("text").collect()]
    assert len(set(texts)) == len(texts)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.filter(F.col("n_tokens") > 0).count() == sizes[-1]
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_pipeline_keeps_the_mixed_order_over_several_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
        left = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id").isin([r.doc_id for r in rows]))
        mixed = mixing.mix(left).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.doc_id for r in rows] == [r.doc_id for r in mixed]
    assert [(r.mix_slot, r.position) for r in rows] == [(r.mix_slot, r.position) for r in mixed]


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_a_folder_is_asked_for_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_root(Session())
