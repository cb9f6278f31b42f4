import random

import numpy as np
from pyspark.sql import functions as F

from frisk.llm import language_id as L
from tests.conftest import SF


def test_held_out_accuracy_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.held_out == L.python_held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) >= 0.9 * len(held) and {r.lang_pred for r in rows} <= {r.lang for r in rows} | {"und"}


def _docs(spark, extra=()):
    rng = random.Random(1)
    words = {"aa": ["kala", "miko", "tuna"], "bb": ["strog", "brzk", "vlth"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for k in range(200) for lang in (["aa", "bb"][k % 2],)]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string")


def test_odd_rows(spark):
    odd = [(None, "kala kala", None), (900, None, "aa"), (901, "", "aa"), (902, "123 ... !", "aa"), (903, "strog " * 300_000, None), (903, "strog " * 300_000, None)]
    rows = L.identify(_docs(spark, odd)).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == 206 and by[None][0] == "aa" and by[903][0] == "bb" and {by[k] for k in (900, 901, 902)} == {("und", 0.0)}
    assert L.identify(_docs(spark).limit(0)).count() == 0
    no_labels = _docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(no_labels).collect()} == {"und"}


def test_nothing_is_learned_from_held_out_documents(spark):
    docs = _docs(spark)
    lied = docs.withColumn("lang", F.when(L.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    assert sorted(map(tuple, L.identify(docs).collect())) == sorted(map(tuple, L.identify(lied).collect()))


def test_blocks_do_not_change_counts(monkeypatch):
    text = "Ünïcode words and more words " * 50
    whole = L.subwords(text)
    monkeypatch.setattr(L, "_BLOCK", 64)
    assert np.array_equal(whole, L.subwords(text)) and whole.sum() == sum(len((" " + " ".join(text.lower().split()) + " ").encode()) - n + 1 for n in L.SIZES)


def test_far_texts_are_rejected():
    rng = np.random.default_rng(0)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    texts = [(make("abcde"), "x") for _ in range(100)] + [(make("vwxyz"), "y") for _ in range(100)]
    model = L.train([L.subwords(t) for t, _ in texts], [v for _, v in texts])
    assert model.predict(make("abcde"))[0::2] == ("x", True) and not model.predict("日本語のテキストです")[2]
