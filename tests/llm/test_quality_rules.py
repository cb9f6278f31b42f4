import random
import re
from types import SimpleNamespace
from weakref import WeakSet

import pyarrow as pa
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from frisk.llm import quality_rules as Q


def _want(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:]))
    hit = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)}
    n, rep = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 50 or 100 * rep > 50 * n


def _texts():
    rng = random.Random(4)
    pool = ["a", "be", "été", "x#y", " ", "|", "Wörter", "z\x1cz"]
    yield from (None, "", " \n\t", "one", "a b a b a b", "same same same same", "l1\nl1\n \n \nl1")
    for n in (3, 10, 60, 400):
        for k in (2, 8):
            yield "".join(rng.choice(pool[:k]) + rng.choice([" ", "\n", "\t ", "\r\n"]) for _ in range(n))


def test_measures(spark):
    rows = [(k, t, 1) for k, t in enumerate(_texts())] + [(None, "no id " * 60, 2), (3, "one", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    out = Q.quality_filter(docs)
    assert out.columns[:3] == docs.columns
    cols = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words", "__base_failed"]
    got = sorted(((r.doc_id, r.text, *[r[c] for c in cols]) for r in out.collect()), key=str)
    assert got == sorted(((i, t, *_want(t)) for i, t, _ in rows), key=str)
    assert Q.quality_filter(docs.limit(0)).count() == 0


def test_order_follows_the_measures_and_verdicts_do_not(spark):
    rules = (Q.Rule("never", lambda t: False), Q.Rule("short", lambda t: t.n_words < 5), Q.Rule("all", lambda t: True))
    m = spark.createDataFrame([("never", 1.0, 0), ("short", 2.0, 4), ("all", 9.0, 90)], "rule string, seconds double, rejections long")
    assert [r.name for r in Q.cascade(m, rules)] == ["all", "short", "never"]
    docs = spark.createDataFrame([(1, "a b c"), (2, "word " * 9 + "x y z " + " ".join(map(str, range(60))))], "doc_id long, text string")
    for order in (rules[:2], rules[1::-1]):
        assert {r.doc_id: r["__kept"] for r in Q.apply_rules(docs, order).collect()} == {1: False, 2: True}


@pytest.mark.parametrize("junk", ["Le%%% de&&& " * 60, "AB!! CD!! EF!! " + " ".join(f"W{chr(65 + k % 26)}{chr(65 + k // 26)}X!!" for k in range(99)),
                                  " ".join(f"w{k} |" for k in range(99)), "again " * 99])
def test_junk_is_rejected_and_prose_kept(junk):
    assert any(r.rejects(Q.Text(junk)) for r in Q.RULES)
    prose = "Été à la plage, nous parlons de tout. " + " ".join(f"mot{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70))
    assert not any(r.rejects(Q.Text(prose)) for r in Q.RULES)


def test_without_counts_a_rejected_document_leaves_at_once(spark):
    short = Q.Text("a b c")
    assert not Q.keeps(short, Q.RULES) and set(short.__dict__) == {"text", "raw", "words", "n_words"}
    rows = [(k, t) for k, t in enumerate([*_texts(), " ".join(f"mot{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70))])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = Q.quality_filter(docs, counts=False)
    assert out.columns == ["doc_id", "text", "__kept"]
    want = {r.doc_id: r["__kept"] for r in Q.quality_filter(docs).collect()}
    assert {r.doc_id: r["__kept"] for r in out.collect()} == want and set(want.values()) == {True, False}


@pytest.mark.parametrize("n", [3_999, 4_000, 7_998, 50_000])
def test_few_distinct_words_at_any_length(n):
    rng = random.Random(n)
    rejects = {r.name: r.rejects for r in Q.RULES}["few_distinct_words"]
    assert rejects(Q.Text(" ".join(rng.choices([f"w{k}" for k in range(100)], k=n))))
    prose = rng.choices([f"w{k}" for k in range(2_000)], [1 / (k + 1) for k in range(2_000)], k=n)  # 50,000 words hold fewer than one in 20
    assert not rejects(Q.Text(" ".join(prose)))


@pytest.mark.parametrize("counts", [True, False])
def test_one_text_at_a_time_is_held(monkeypatch, counts):
    alive, most = WeakSet(), []

    class Watched(Q.Text):
        def __init__(self, text):
            super().__init__(text)
            alive.add(self)
            most.append(len(alive))

    monkeypatch.setattr(Q, "Text", Watched)
    docs = SimpleNamespace(columns=["doc_id", "text"], schema=StructType([StructField("doc_id", LongType()), StructField("text", StringType())]),
                           mapInArrow=lambda run, schema: run)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": [f"a b c{k}" for k in range(199)] + [None]})
    out = list(Q.apply_rules(docs, Q.RULES, counts=counts)(iter([batch])))
    assert sum(b.num_rows for b in out) == len(most) == 200 and max(most) <= 2
