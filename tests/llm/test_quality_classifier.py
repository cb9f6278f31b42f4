import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frisk.llm import quality_classifier as Q
from tests.conftest import SF


def _docs(spark, n=400):
    rng = random.Random(9)
    words = ["river", "stone", "garden", "music", "paper", "window", "mountain", "letter", "summer", "forest"]
    rows, labels = [], []
    for k in range(n):
        bad, toxic = k % 5 == 0, k % 7 == 0
        text = [rng.choice(words) + ("***" if bad else "") for _ in range(60)] + ["scoundrel"] * toxic
        rows.append((k, " ".join(text), "en" if k % 2 else "fr", f"s{k % 3}", 0))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_labelled_and_unlabelled_documents(spark):
    docs, labels = _docs(spark)
    out = {r.id: r.kept for r in Q.classify(docs, labels.filter("doc_id < 200")).collect()}
    wrong = [k for k, kept in out.items() if kept != (k % 5 != 0 and k % 7 != 0)]
    assert len(out) == 400 and len(wrong) <= 4


def test_odd_rows_and_empty_tables(spark):
    docs, labels = _docs(spark, 100)
    odd = spark.createDataFrame([(None, None, None, None, 0), (900, "", "en", None, 0), (900, "", "en", None, 0), (901, "word " * 100_000, None, "s9", 0)], docs.schema)
    out = Q.classify(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, None, 1), (3, None, None)], labels.schema)))
    assert out.count() == 104 and out.filter("quality_score BETWEEN 0 AND 1 AND toxic_score BETWEEN 0 AND 1").count() == 104
    assert out.filter("id = 900").distinct().count() == 1
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert Q.classify(docs, labels.limit(0)).filter("kept").count() == 100


def test_site_rates_shrink_toward_the_level_above(spark):
    rows = [("a", "a/x", 4.0)] * 300 + [("a", "a/y", -4.0)] + [("b", "b/x", -4.0)] * 300 + [("b", None, 0.0), (None, None, 0.0)]
    out = {(r["__h"], r["__p"]): r["__prior"] for r in Q.posteriors(spark.createDataFrame(rows, "host string, path string, __q double")).collect()}
    assert out[("a", "a/x")] > 1 > -1 > out[("b", "b/x")]
    assert out[("b", "b/x")] < out[("a", "a/y")] < out[("a", "a/x")]  # one document moves a path little
    assert abs(out[(None, None)]) < abs(out[("a", "a/x")])


def test_fit_is_deterministic_and_neutral_without_two_classes():
    x = [Q.features(t) for t in ("a b c", "### ###", None)]
    assert Q.fit(x, np.array([1, 1, 1])).logit(x[0]) == 0
    assert Q.fit(x, np.array([1, 0, 0])).logit(x[1]) == Q.fit(x, np.array([1, 0, 0])).logit(x[1])


@pytest.mark.parametrize("share", [0.9])
def test_held_out_accuracy(spark, share):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0)
    got = Q.classify(docs, train).join(labels.join(train, "doc_id", "left_anti"), F.col("id") == F.col("doc_id"))
    row = got.agg(F.avg(((F.col("quality_score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()
    assert row[0] >= share
