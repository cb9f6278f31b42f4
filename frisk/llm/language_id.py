"""Language identification: averaged hashed subword embeddings under a linear softmax.

A document is the average of the embeddings of its subwords (byte n-grams of the lower-case text, words marked at both ends),
hashed into buckets.  Embeddings and the softmax are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled documents.  A part of the sample sets the temperature (so that scores are calibrated, never sharper than trained) and, from its right predictions, the score
and the share of known subwords under which a prediction is rejected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frisk.functions.keep import stored
from frisk.llm.rows import slices

BUCKETS, DIMENSIONS, SIZES = 1 << 13, 16, (2, 3, 4)
PER_LANGUAGE = 500  # training documents a language at most, chosen by id hash
UNKNOWN = "und"
_BLOCK = 1 << 20


def subwords(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text; counted block by block, so a long text needs no more memory."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), "uint8").astype("uint32")
    counts = np.zeros(BUCKETS, "float64")
    for start in range(0, len(raw), _BLOCK):
        block = raw[start:start + _BLOCK + max(SIZES) - 1]
        for n in SIZES:
            m = min(len(block) - n + 1, _BLOCK)
            if m > 0:
                h = np.full(m, n, "uint32")
                for k in range(n):
                    h = (h ^ block[k:k + m]) * np.uint32(16777619)
                h ^= h >> np.uint32(15)
                counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    known: np.ndarray | None = None  # buckets seen in training
    least_known: float = 0.0

    def logits(self, shares: np.ndarray) -> np.ndarray:
        return shares @ self.embeddings @ self.weights + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted); ``und`` with score 0 for a text without letters, or when nothing was learned."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        counts = subwords(text)
        at = np.flatnonzero(counts)
        z = ((counts[at] / counts.sum()) @ self.embeddings[at] @ self.weights + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        known = counts[self.known].sum() / counts.sum() if self.known is not None else 1.0
        return self.languages[best], float(p[best]), bool(p[best] >= self.reject_below and known >= self.least_known)


def train(counts: list[np.ndarray], labels: list[str], epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 3) -> Model:
    """Adam steps on mini-batches; one row in five sets temperature and rejection.  One language needs no training."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    shape = (len(languages),)
    # embeddings start at zero, so a subword never seen in training says nothing
    model = Model(languages, np.zeros((BUCKETS, DIMENSIONS), "float32"), rng.normal(0, 0.3, (DIMENSIONS, *shape)).astype("float32"), np.zeros(shape, "float32"))
    if len(languages) < 2:
        return model
    x = np.stack([c / max(c.sum(), 1.0) for c in counts]).astype("float32")
    scale = np.float32(1 / max(float(np.sqrt((x * x).sum(axis=1).mean())), 1e-9))  # rows of unit length on average
    x *= scale
    y = np.array([languages.index(v) for v in labels])
    order = rng.permutation(len(y))
    held, used = order[:len(y) // 5], order[len(y) // 5:]
    parts = [model.embeddings, model.weights, model.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            step += 1
            h = x[rows] @ parts[0]
            z = h @ parts[1] + parts[2]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grads = (x[rows].T @ (p @ parts[1].T), h.T @ p, p.sum(axis=0))
            for part, grad, (m, v) in zip(parts, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model.embeddings *= float(scale)
    model.known = x[used].any(axis=0)
    if len(held):
        _calibrate(model, x[held] / scale, y[held])
    return model


def _calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    z = model.logits(x.astype("float64"))

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(y)), y]).mean())
    model.temperature = min(np.geomspace(1, 8, 31).tolist(), key=loss)
    s = z / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.argmax(axis=1) == y
    if right.any():
        model.reject_below = float(np.quantile(p.max(axis=1)[right], 0.01)) * 0.9
        model.least_known = float(np.quantile(x[right][:, model.known].sum(axis=1), 0.01)) * 0.9


def held_out(id_col):
    """Documents that nothing is learned from: crc32 of the id as text, divisible by 5; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(id, lang, buckets, counts): about ``per_language`` documents of each language by id hash, twice that at the very most.

    Counting languages is one grouped aggregation; texts stay where they are, only counts of subwords are returned.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = stored(usable.groupBy("lang").count())  # own table: known to be small, so texts are not shuffled by language
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    drawn = usable.join(sizes, "lang").filter(place * F.col("count") < per_language).drop("count")

    def run(batches):
        for batch in slices(batches, "text"):
            rows = [(i, lang, subwords(t)) for lang, i, t in zip(*[c.to_pylist() for c in batch.columns]) if has_letter(t)]
            if rows:
                at = [np.flatnonzero(c) for _, _, c in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array(at, pa.list_(pa.int32())),
                                                  pa.array([r[2][a] for r, a in zip(rows, at)], pa.list_(pa.float32()))], names=["id", "lang", "buckets", "counts"])
    return drawn.select("lang", "id", "text").mapInArrow(run, "id long, lang string, buckets array<int>, counts array<float>")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """The model, trained on the driver from the bounded sample."""
    table = training_sample(docs, id_col, text_col, lang_col, per_language).toArrow().sort_by([("lang", "ascending"), ("id", "ascending")])
    counts, labels, taken = [], [], {}
    for lang, at, n in zip(table.column("lang").to_pylist(), table.column("buckets").combine_chunks(), table.column("counts").combine_chunks()):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= 2 * per_language:
            row = np.zeros(BUCKETS, "float32")
            row[at.values.to_numpy()] = n.values.to_numpy()
            counts.append(row)
            labels.append(lang)
    return train(counts, labels)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) per row; only the text is looked at."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            new = [pa.array(v, k) for v, k in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """Train on the documents that are not held out, predict all.

    Null and letterless texts are ``und``; null languages teach nothing; without any usable label everything is ``und``.
    Repeated rows get equal predictions; an empty table gives an empty result.
    """
    return predict(docs, fit(docs, id_col, text_col, lang_col, per_language), id_col, text_col)


def python_held_out(doc_id: int | None) -> bool:
    """The same rule outside Spark."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
