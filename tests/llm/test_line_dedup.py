import hashlib
import random

from frisk.llm import line_dedup


def _want(rows, min_chars, min_documents):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(low)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(i)
    keep = {k: max(v, key=lambda x: (x is not None, x)) for k, v in held.items() if len(v) >= min_documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keep or keep[key(x)] == i]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def _got(docs, **kw):
    return sorted(((r.doc_id, r.text, r["__n_lines"], r["__n_dropped"]) for r in line_dedup.dedup_lines(docs, **kw).collect()), key=str)


def test_against_a_plain_statement(spark):
    rng = random.Random(3)
    pool = [f"Common Line {k} é" for k in range(6)] + ["  common line 1 É\t", "COMMON LINE 1 é", "", " ", "ab"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 150])))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n"), (None, pool[2]), (3, rows[3][1]), (3, "Common line 2 é\nown"), (60, "\n".join([pool[0]] * 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (2, 5):
        assert _got(docs, min_chars=5, min_documents=n) == _want(rows, 5, n)


def test_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "x" * 50, 9, "a") for k in range(6)], "doc_id long, text string, pos long, h1 string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns[:4] == docs.columns and {(r.doc_id, r.text) for r in out.collect()} == {(k, "x" * 50 if k == 5 else "") for k in range(6)}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(k, "x" * 50) for k in range(6)], "doc_id long, text string")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    firsts = line_dedup.first_occurrences(line_dedup.line_table(docs, "doc_id", "text", 40))._jdf.queryExecution().executedPlan().toString()
    assert firsts.count("Exchange") == 1 and "rangepartitioning" in firsts


def test_sha_of_the_kept_text(spark):
    from pyspark.sql import functions as F
    docs = spark.createDataFrame([(1, "a\n\nb\n")], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).select(F.sha2("text", 256)).first()[0] == hashlib.sha256(b"a\n\nb\n").hexdigest()
