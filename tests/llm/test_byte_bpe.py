import hashlib
from collections import Counter

import public_tokenizers as P
import pytest

from frisk.llm import byte_bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "a", "It's 'we'll  \n\n  done'", "x" * 400, "  " * 90 + "y", "naïve café ☕ 12345 " * 20, "don't " * 60,
         "word\n\n\n" * 40, "   tab\t\tend ", "日本語のテキスト" * 30, "<|endoftext|> it're " * 15, "a" * 63 + "'re" + "b" * 63 + "'s"]


def _want(text):
    ids = byte_bpe.encoding(RANKS, P.PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (64, 16), (40, 30)])
def test_pieces_equal_the_library_on_whole_texts(spark, chunk, overlap):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again"), (None, TEXTS[7], "no id"), (7, "other text, same id " * 9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.per_document(docs, byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN, chunk=chunk, overlap=overlap), RANKS, P.PATTERN), chunk=chunk)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, *_want(t)) for i, t, _ in rows), key=key)


def test_long_texts_are_cut(spark):
    docs = spark.createDataFrame([(1, "some words here " * 200), (2, "z" * 3000)], "doc_id long, text string")
    n = Counter(r.doc_id for r in byte_bpe.encode(docs, RANKS, P.PATTERN, chunk=64, overlap=16).collect())
    assert n[1] == 50 and n[2] == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.per_document(docs, byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)).count() == 0
