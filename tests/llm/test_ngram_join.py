import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from frisk.functions.keep import Scratch
from frisk.llm import ngram_join as J
from frisk.llm.components import components


def _set(text, n):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[words[k:] for k in range(n)])) if len(words) >= n else frozenset([tuple(words)] if words else [])


def _want(rows, n, percent):
    sets = [(i, _set(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def _rows(seed):
    rng = random.Random(seed)
    words = [f"W{k}é" for k in range(300)]

    def edit(ws, times):
        ws = list(ws)
        for _ in range(times):
            at, kind = rng.randrange(len(ws)), rng.choice("sdi")
            if kind == "s":
                ws[at] = rng.choice(words)
            elif kind == "i":
                ws.insert(at, rng.choice(words))
            elif len(ws) > 1:
                del ws[at]
        return ws
    base = [rng.choice(words) for _ in range(90)]
    texts = [edit(base, rng.choice([0, 1, 2, 3, 5])) for _ in range(40)] + [base[:k] for k in (60, 70, 80, 85)]
    for size in (1, 2, 3, 9, 12, 30, 200):
        own = [rng.choice(words) for _ in range(size)]
        texts += [edit(own, rng.choice([0, 1, 2])) for _ in range(3)]
    rows = [(k, rng.choice([" ", "\n"]).join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(1000, None), (1001, ""), (1002, " \t"), (None, rows[0][1]), rows[1], (rows[2][0], rows[3][1])]


@pytest.mark.parametrize("small,n,percent", [(12, 3, 90), (3, 3, 90), (4, 5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, small, n, percent):
    monkeypatch.setattr(J, "SMALL", small)
    rows = _rows(small)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n long, sigs string").repartition(3)
    assert sorted((tuple(r) for r in J.jaccard_groups(docs, J.Similarity(n, percent)).collect()), key=str) == _want(rows, n, percent)


def test_empty_table(spark):
    assert J.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rule", [J.Similarity(3, 90), J.Similarity(5, 80, 1, 3), J.Similarity(3, 70, 2, 4)])
def test_similar_sets_share_a_signature(rule):
    rng = np.random.default_rng(6)
    for _ in range(400):
        size = int(rng.integers(1, 400))
        a = rng.integers(0, 2**63, size, dtype="uint64")
        most = rule.most_different(2 * size)
        gone, new = (int(x) for x in rng.integers(0, most // 2 + 2, 2))
        b = np.unique(np.append(a[gone:], rng.integers(0, 2**63, new, dtype="uint64")))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= rule.percent * (len(a) + len(b) - common):
            assert np.intersect1d(J.signatures(a, rule), J.signatures(b, rule)).size


@pytest.mark.parametrize("rule", [J.Similarity(3, 90), J.Similarity(5, 80), J.Similarity(3, 70, 2, 4)])
def test_similar_sets_share_more_signatures_than_their_surplus(rule):
    rng, tested = np.random.default_rng(7), 0
    for _ in range(600):
        size = int(rng.integers(1, 300))
        a = rng.integers(0, 2**63, size, dtype="uint64")
        most = rule.most_different(2 * size)
        gone, new = (int(x) for x in rng.integers(0, most // 2 + 2, 2))
        b = np.unique(np.append(a[gone:], rng.integers(0, 2**63, new, dtype="uint64")))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= rule.percent * (len(a) + len(b) - common):
            (x, over_x), (y, over_y) = J._signatures(a, rule), J._signatures(b, rule)
            both = np.intersect1d(x, y)
            shared = [int((both & 1 == parity).sum()) for parity in (0, 1)]
            bands = {rule.band(len(s))[0] + k for s in (a, b) for k in (0, 1)} & set.intersection(*({rule.band(len(s))[0], rule.band(len(s))[0] + 1} for s in (a, b)))
            assert all(shared[i & 1] > max(over_x[i & 1], over_y[i & 1]) for i in bands)
            tested += 1
    assert tested > 100


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(5, 5), (7, 7), (130, 100), (50, 51), (51, 50)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect())
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 131)} | {50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_chain_of_crowds_is_one_component(spark):
    """crowd - y - x - crowd: at one level only y links to the middle, at the next only x links to the next middle."""
    first, u, v, w = ([f"{c}{k}" for k in range(size)] for c, size in (("a", 90), ("u", 15), ("v", 15), ("w", 15)))
    last = first + u + v + w
    sets = [first] + [first + [f"p{k}"] for k in range(40)] + [first + u, first + u + v, last] + [last + [f"q{k}"] for k in range(14)]
    rows = [(k, " ".join(s)) for k, s in enumerate(sets)]
    docs, rule, scratch = spark.createDataFrame(rows, "doc_id long, text string"), J.Similarity(1, 80), Scratch(spark)
    base = J.signed(docs, rule, "doc_id", "text", scratch).withColumn("sigs", F.array(F.lit(1).cast("long")))  # all are candidates
    classes = base.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    got = components(J.links(docs, base, classes, rule, "doc_id", "text", scratch), scratch)
    assert sorted(map(tuple, got.collect())) == [(i, c) for i, _, c in sorted(_want(rows, 1, 80))]


def test_texts_that_only_share_a_passage_are_not_compared(spark, monkeypatch):
    """A part that holds one common gram alone made most long texts with the passage candidates."""
    rng, asked, sets = random.Random(8), [], J._sets
    passage = [f"p{k}" for k in range(40)]
    rows = [(k, " ".join([f"w{rng.randrange(10**6)}" for _ in range(300)] + passage)) for k in range(200)]
    monkeypatch.setattr(J, "_sets", lambda docs, ids, *more: asked.append(ids.count()) or sets(docs, ids, *more))
    got = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), J.Similarity(5, 80)).collect()
    assert all(r["doc_id"] == r["component_id"] for r in got)
    assert sum(asked) <= 100


@pytest.mark.parametrize("paired", [12])
def test_later_levels_paired_or_divided_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(J, "PAIRED", paired)
    rows = _rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in J.jaccard_groups(docs, J.Similarity(3, 90)).collect()), key=str) == _want(rows, 3, 90)


def test_components_of_stars_end_at_once(spark):
    scratch = Scratch(spark)
    assert components(spark.createDataFrame([(k % 3, k) for k in range(3, 30)], "a long, b long"), scratch).count() == 30
    assert scratch.n == 1
