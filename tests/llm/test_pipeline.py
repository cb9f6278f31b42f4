from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF


def test_stages_keep_columns_and_the_right_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 41 > 0, F.col("text")))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "ngram_join", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("start = 0").count() == docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = docs.join(labels, "doc_id").agg(F.count_if(F.col("quality") == 0)).first()[0]
    assert left == 0 and docs.filter("text IS NULL").count() == 0


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_every_corpus_query_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
