import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from frisk.llm import packing

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_word_ids_equal_the_library(library):
    rng, ids = random.Random(2), packing.WordIds(PATH, most=50)
    letters = "abcdefghijklmnopqrstuvwxyzABCé ÜäñßΣİ日本́\xa0\x85\x1c.,'!0123\n\t<|>×"
    texts = ["", "I'll say it's <|endoftext|> done<|startoftext|>x", "ΑΣ ΣΑΣ é ﬁ Ⅳ ½", "don't DON'T we've'll"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    vocabulary = [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii()]
    texts += ["".join(rng.sample(vocabulary, 3)) + " " + rng.choice(vocabulary) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def _check(rows, docs_ids, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, ids in docs_ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("capacity", [16, 4096])
def test_every_id_lies_in_one_piece_without_padding(spark, library, capacity):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "Wörter", "x1", "unbelievable"]) for _ in range(rng.choice([0, 1, 5, 9, 200]))) for _ in range(300)]
    texts += [None, "", "a b"] + ["same words again here"] * 200
    docs = spark.createDataFrame([(k, t, 0, "y") for k, t in enumerate(texts)], "doc_id long, text string, length int, rank string").repartition(7)
    want = {k: library.encode(t or "", add_special_tokens=False).ids + [2] for k, t in enumerate(texts)}
    rows = packing.pack(docs, PATH, capacity).collect()
    assert _check(rows, want, capacity) == 0
    seqs = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(docs, PATH, capacity).collect()}
    assert sum(map(len, seqs.values())) == sum(map(len, want.values())) and max(map(len, seqs.values())) <= capacity
    assert {r.sequence_id for r in rows} == set(seqs)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in rows) == 7 and sum(r.doc_id == 1 for r in rows if r.start == 0) == 2
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_fill_is_the_best_subset_sum():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        seed = max(counts)
        sums = {seed}
        for k, v in counts.items():
            sums = {s + k * j for s in sums for j in range(v + (k != seed))}
        chosen = packing.fill(counts, seed, 50)
        assert sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= 50)
        assert all(v <= counts[k] for k, v in chosen.items())
