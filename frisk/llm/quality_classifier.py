"""Quality classifier with site posteriors (hierarchical empirical Bayes).

A linear model on hashed words and counts, fitted on labelled documents, gives each document its evidence.  The evidence is summed
per path, per host and over everything by grouped aggregation.  A host's rate is shrunk toward the global rate and a path's rate
toward its host's, each by a prior strength taken from how much rates vary between sites; a site with few documents therefore
falls back on the level above it.  A document's score combines its own evidence with the prior odds of its path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.functions.keep import stored
from frisk.llm.rows import slices

BUCKETS = 1 << 18
MIN_Z, MIN_DOCUMENTS = 5.0, 3  # buckets whose share differs between the classes by so many standard errors, and that so many have
MAX_LABELLED = 12_000  # labelled documents that a model is fitted on at most; a fixed share of them by id hash
_LETTER = re.compile(r"[^\W\d_]+")
_SHAPE = ("log_words", "symbols", "capitals", "distinct", "digits", "most_common", "word_length", "lines")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words, shape): the buckets of the text's distinct lower-case letter runs and of their beginnings, and a few shares of the whole text."""
    import xxhash
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    runs = {run for w in counts for run in _LETTER.findall(w.decode().lower())}
    runs |= {f"{run[:5]}*" for run in runs if len(run) > 5}  # one bucket for the inflected forms of a stem
    buckets = np.unique(np.fromiter((xxhash.xxh3_64_intdigest(r) % BUCKETS for r in runs), "int64", len(runs)))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>!{}[]=~^\\@_"))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    shape = np.array([np.log1p(len(words)), min(1.0, symbols / n), min(1.0, 4 * capitals / size), len(counts) / n, min(1.0, digits / n),
                      max(counts.values(), default=0) / n, min(3.0, len(text) / n / 8), min(3.0, raw.count(b"\n") / n * 10)])
    return buckets, shape


@dataclass
class Linear:
    """log odds = bias + shape . w + sum of the text's bucket weights."""

    bias: float
    shape: np.ndarray
    buckets: np.ndarray

    def logit(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.bias + found[1] @ self.shape + self.buckets[found[0]].sum())


def informative(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Which buckets' document shares differ between the classes beyond chance; words of a few documents never do."""
    hits = np.stack([np.bincount(np.concatenate([r[0] for r, c in zip(rows, y) if c == k]), minlength=BUCKETS) for k in (0, 1)])
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    share, both = hits / n[:, None], hits.sum(axis=0) / n.sum()
    z = np.abs(share[1] - share[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n).sum())
    return (z >= MIN_Z) & (hits.sum(axis=0) >= MIN_DOCUMENTS)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 30, rate: float = 0.5, seed: int = 7, words_only: bool = False) -> Linear:
    """Logistic regression by AdaGrad on informative buckets and shape; both classes weigh the same.

    ``words_only`` leaves the shape out.  With one class or no rows the model is neutral.
    """
    model = Linear(0.0, np.zeros(len(_SHAPE)), np.zeros(BUCKETS))
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return model
    used = informative(rows, y)
    rows = [(b[used[b]], s * (not words_only)) for b, s in rows]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    g0, g1, g2 = 1e-6, np.full(len(_SHAPE), 1e-6), np.full(BUCKETS, 1e-6)
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            buckets, shape = rows[k]
            z = model.logit(rows[k])
            d = weight[k] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k])
            if abs(d) < 1e-3:
                continue
            g0 += d * d
            model.bias -= rate * d / np.sqrt(g0)
            g1 += (d * shape) ** 2
            model.shape -= rate * d * shape / np.sqrt(g1)
            g2[buckets] += d * d
            model.buckets[buckets] -= 0.2 * rate * d / np.sqrt(g2[buckets])
    return model


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """(id, buckets, shape, quality, toxic) of the labelled documents with the smallest id hashes, ``most`` at most.

    Null labels are left out; features are computed where the texts lie.
    """
    known = labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").alias("id"), "quality", "toxic").dropDuplicates(["id"])
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # ``most`` rows

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())),
                                              batch.column(2).cast(pa.int64()), batch.column(3).cast(pa.int64())], names=["id", "buckets", "shape", "quality", "toxic"])
    return rows.mapInArrow(run, "id long, buckets array<long>, shape array<double>, quality long, toxic long")


def models(sample: DataFrame) -> tuple[Linear, Linear]:
    """(quality, toxicity) fitted on the bounded sample, on the driver."""
    table = sample.toArrow().sort_by("id")
    x = [(np.array(b.values, "int64"), np.array(s.values, "float64")) for b, s in zip(table.column("buckets").combine_chunks(), table.column("shape").combine_chunks())]
    return fit(x, table.column("quality").to_numpy()), fit(x, table.column("toxic").to_numpy(), words_only=True)


def evidence(docs: DataFrame, quality: Linear, toxicity: Linear, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with __q and __t: the document's own log odds of good quality and of toxicity."""
    rows = docs.select(*[c for c in docs.columns if c != text_col], F.col(text_col).alias("__text"))
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType([f for f in docs.schema if f.name != text_col] + [StructField("__q", DoubleType()), StructField("__t", DoubleType())])

    def run(batches):
        for batch in slices(batches, "__text", 4 << 20):
            found = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            new = [pa.array([m.logit(f) for f in found], pa.float64()) for m in (quality, toxicity)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], "__q", "__t"])
    return rows.mapInArrow(run, schema)


def _strength(sites: DataFrame, mean: float) -> float:
    """Prior strength by the method of moments: how many documents the level above is worth."""
    row = sites.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("v"), F.count(F.lit(1)).alias("k"),
                    F.sum(F.col("n") * F.col("n").cast("double")).alias("n2")).first()
    if not row["k"] or row["k"] < 2:
        return 1.0
    spread = mean * (1 - mean)
    lot = max(row["n"] - row["n2"] / row["n"], 1e-9)
    between = max((row["v"] - (row["k"] - 1) * spread) / lot, spread / 1000)
    return min(max(spread / between - 1, 1.0), 1000.0)


def posteriors(scored: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """(host, path, prior log odds - global log odds), from sums per path, per host and over all."""
    rows = scored.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("__q"))))))
    paths = stored(rows.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = stored(paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    by_host, by_path = _strength(hosts, mean), _strength(paths, mean)
    rate = hosts.select(F.col(host).alias("__h"), ((F.col("s") + by_host * mean) / (F.col("n") + by_host)).alias("rate"))
    joined = paths.join(rate, paths[host].eqNullSafe(rate["__h"])).withColumn("r", (F.col("s") + by_path * F.col("rate")) / (F.col("n") + by_path))
    r = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("r")))
    return joined.select(F.col(host).alias("__h"), F.col(path).alias("__p"), (F.log(r / (1 - r)) - float(np.log(mean / (1 - mean)))).alias("__prior"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
             id_col: str = "doc_id", text_col: str = "text", site_weight: float = 0.5, most: int = MAX_LABELLED) -> DataFrame:
    """(id, __tk, quality_score, toxic_score, kept) per row of ``docs``.

    ``host`` and ``path`` name a document's site on two levels (default: its source, and its language there); null is a site of
    its own.  A document is kept when it is more likely good than not, its site counted in with ``site_weight``, and not more likely toxic
    than not.  Null and empty texts have the evidence of an empty text.  Repeated rows get equal scores.  Without labels all is neutral and kept.
    """
    from frisk.llm.rows import text_key
    quality, toxicity = models(labelled(docs, labels, id_col, text_col, most))
    rows = docs.select(F.col(id_col).alias("id"), (F.col("source") if host is None else host).cast("string").alias("host"),
                       (F.col("lang") if path is None else path).cast("string").alias("path"), text_key(F.col(text_col)).alias("__tk"), F.col(text_col).alias("text"))
    scored = stored(evidence(rows, quality, toxicity))
    sites = stored(posteriors(scored))
    joined = scored.join(sites, scored["host"].eqNullSafe(sites["__h"]) & scored["path"].eqNullSafe(sites["__p"]))
    sigmoid = lambda z: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    good = sigmoid(F.col("__q") + site_weight * F.col("__prior"))
    return joined.select("id", "__tk", good.alias("quality_score"), sigmoid(F.col("__t")).alias("toxic_score")).withColumn(
        "kept", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") <= 0.5))
