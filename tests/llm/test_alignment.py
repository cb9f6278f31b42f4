import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from frisk.llm import alignment, rank_bpe

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["", None, "a", " ", "It's done", "tokenization of antidisestablishmentarianism", "日本語のテキスト ☕", "a ▁ b", "<s>x</s><|endoftext|>", "tab\tnew\nline  two",
         "naïve café " * 40, "x" * 300, "It's done", "\x00\x1f", "the the the"]


def _brute(texts):
    """Plain loops over both libraries' tokens."""
    lib_a, lib_b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib_a.encode_special_tokens = True
    letters = rank_bpe.byte_letters()

    def raw_b(k):
        piece = lib_b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if lib_b.is_byte(k) else piece.replace("▁", " ").encode()
    docs = []
    for text in texts:
        a, b = [], []
        if text:
            enc = lib_a.encode(" " + text, add_special_tokens=False)
            a = [(k, bytes(letters[c] for c in t)) for k, t in zip(enc.ids, enc.tokens)]
            b = [(k, raw_b(k)) for k in lib_b.encode(text)]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for k, raw in side:
                out.append((k, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        docs.append(spans)
    count = Counter((x[0], y[0]) for sa, sb in docs for x in sa for y in sb if x[2] == y[2])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    rows = []
    for sa, sb in docs:
        links = [(x[0], y[0]) for x in sa for y in sb if x[2] == y[2]]
        cuts = sorted({x[2] for x in sa} & {y[2] for y in sb})
        groups, lo = [], 0
        for hi in cuts:
            groups.append([[str(k) for k, _, e in side if lo < e <= hi] for side in (sa, sb)])
            lo = hi
        said = ";".join(",".join(ga) + "|" + ",".join(gb) for ga, gb in groups)
        rows.append((len(sa), len(sb), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
                     hashlib.sha256(said.encode()).hexdigest() if said else "", sum(len(ga) * len(gb) for ga, gb in groups)))
    return rows, docs


@pytest.mark.parametrize("most", [alignment.BROADCAST_PAIRS, 3])
def test_rows_equal_brute_force(spark, most):
    docs = spark.createDataFrame([(k if k != 5 else None, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, links string, n_a int")
    aligned = alignment.align(docs, A, B, digest=True)
    out = alignment.report(aligned, alignment.pair_counts(aligned), most).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "n_shared")
    want = [(k if k != 5 else None, *r) for k, r in enumerate(_brute(TEXTS)[0])]
    assert sorted(((r.doc_id, *[r[c] for c in names]) for r in out), key=str) == sorted(want, key=str)


def test_random_texts_equal_brute_force():
    rng = random.Random(5)
    texts = ["".join(rng.choice([" ", "a", "th", "ing", "é", "中", "\n", "▁", "1", ".", "\U0001f600", "<s>"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    both = alignment.pair(A, B)
    got = alignment.align_texts(both, texts)
    rows, docs = _brute(texts)
    shas = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in got["groups"]]
    assert [(*x, s, h) for *x, s, h in zip(got["n_a"], got["n_b"], got["n_groups"], got["n_links"], shas, got["n_shared"])] == [(*r[:4], r[6], r[7]) for r in rows]
    links = [Counter((x[0], y[0]) for x in sa for y in sb if x[2] == y[2]) for sa, sb in docs]
    assert [{(r["a"], r["b"]): r["times"] for r in x} for x in got["links"].to_pylist()] == [dict(c) for c in links]


@pytest.mark.parametrize("kind", ["overlap", "group"])
def test_token_links_equal_brute_force(spark, kind):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {tuple(r) for r in alignment.token_links(docs, A, B, kind).collect()}
    want = set()
    for doc, (sa, sb) in enumerate(_brute(TEXTS)[1]):
        cuts = sorted({x[2] for x in sa} & {y[2] for y in sb})
        group = lambda e: int(np.searchsorted(cuts, e))
        for i, x in enumerate(sa):
            for j, y in enumerate(sb):
                shared = min(x[2], y[2]) - max(x[1], y[1])
                if kind == "overlap" and shared > 0:
                    want.add((doc, i, j, x[0], y[0], shared))
                if kind == "group" and group(x[2]) == group(y[2]):
                    want.add((doc, i, j, x[0], y[0], 1))
    assert got == want


def test_products_equal_dense_ones():
    rng = np.random.default_rng(0)
    for most in (1, 7, 1 << 20):
        x, y = (rng.random((9, 14)) < 0.3).astype(int), (rng.random((14, 8)) < 0.3).astype(int)
        make = lambda m: alignment.Csr.ones(m.sum(1), np.nonzero(m)[1], m.shape[1])
        dense = np.zeros((9, 8), int)
        for i, j, v in make(x).blocks(make(y), most):
            dense[i, j] = v
        assert (dense == x @ y).all()
        assert (make(x).row_sizes(make(y)) == x @ y.sum(1)).all()
        assert (make(x).transposed().starts == make(x.T).starts).all() and (make(x).transposed().columns == make(x.T).columns).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.per_document(docs, A, B).count() == 0 and alignment.token_links(docs, A, B).count() == 0
