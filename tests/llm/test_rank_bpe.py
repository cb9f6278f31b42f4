import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from frisk.llm import rank_bpe

PATH = P.path("byte_bpe_50k.json")
ODD = ["", None, "a", " ", "It's 'we'll  \n\n  done'", "x" * 64, "x" * 65, "ab" * 400, "é" * 32, "é" * 33, "  " * 90 + "y",
       "naïve café ☕ 12345 " * 20, "   tab\t\tend ", "日本語のテキスト" * 30, "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "\x1c \x1dx\x85 y z",
       "word,\nnext.\n\n two!?\n", "Don't they're ’s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _random_texts(n=4000):
    rng = random.Random(7)
    letters = [" "] * 6 + ["a", "b", "the", "'s", "'re", "1", "2", ".", "!", "\n", "\t", "\x1c", "\xa0", "<|endoftext|>", "é", "中", " ", "\U0001f600", "́", "²", "_"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [chr(c) + "a " + chr(c) * 2 + "b" for c in range(0x3100) ]


def test_ids_equal_the_library(library):
    texts = [t or "" for t in ODD] + _random_texts()
    bpe = rank_bpe.RankBpe(PATH)
    got = [ids.tolist() for ids in bpe.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.decode(ids[1::2]) for ids in got] == [library.decode(ids[1::2], skip_special_tokens=False) for ids in got]


def test_plain_special_tokens():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    text = "a<|endoftext|> b"
    assert rank_bpe.RankBpe(PATH).encode([text], plain=True)[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_rank_array_and_heap_agree():
    rng, bpe = random.Random(3), rank_bpe.RankBpe(PATH)
    words = {"".join(rng.choice("abcdetnionsé ") for _ in range(rng.randint(1, 64))) for _ in range(2000)}
    words = [w for w in words if len(w.encode()) <= rank_bpe.SHORT]
    got = bpe.words(words)
    assert all(got[w] == bpe.long_word(w.encode()) for w in words)


def test_forgetting_changes_nothing(library):
    texts = _random_texts(300)[:600]
    bpe = rank_bpe.RankBpe(PATH, most=50)
    got = [ids.tolist() for k in range(0, len(texts), 7) for ids in bpe.encode(texts[k:k + 7])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)] and len(bpe.seen) < 300


def test_unknown_ids_and_broken_utf8(library):
    bpe = rank_bpe.RankBpe(PATH)
    ids = bpe.encode(["日本"])[0].tolist()
    assert bpe.decode(ids[1:]) == library.decode(ids[1:], skip_special_tokens=False)
    assert bpe.decode([64, 60000, 65]) == bpe.decode([64, 65])


def test_per_document(spark, library):
    rows = [(k, t, "extra", [1]) for k, t in enumerate(ODD)] + [(4, ODD[4], "again", None), (None, ODD[7], None, [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = sorted((tuple(r) for r in rank_bpe.per_document(docs, PATH).collect()), key=str)

    def want(doc, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = ",".join(map(str, ids)).encode()
        return doc, len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got == sorted((want(r[0], r[1]) for r in rows), key=str)
    assert rank_bpe.per_document(docs.limit(0), PATH).count() == 0


def test_encode_and_decode_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "x"), (2, None, None)], "doc_id long, body string, text string")
    out = rank_bpe.decode(rank_bpe.encode(docs, PATH, "body", "tokens"), PATH, "tokens", "back").collect()
    assert [(r.doc_id, r.text, r.back) for r in out] == [(1, "x", "some text"), (2, None, "")]
