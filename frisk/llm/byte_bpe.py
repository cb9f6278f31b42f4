"""Byte-level BPE encoding and decoding of texts of any length.

A long text is cut into chunks that overlap.  Each chunk is split into pre-tokens on its own, in parallel; only positions
near the seams are compared.  Where a chunk's pre-token starts meet those of the chunk before it, both agree from there on
(a match depends on the text after its start alone), so the text can be cut at that place and the pieces encoded apart.
A seam without a common start (a pre-token longer than the overlap) is not cut: its chunks stay one piece.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frisk.llm.rows import slices, text_key

CHUNK, OVERLAP = 32_768, 1_024
_LOOKAHEAD = 4  # an alternative of the pattern looks at most three characters past its start, runs aside
_ROW = ("doc_id", "__tk")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The rank file as an encoding without special tokens; loaded once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for part in slices([batch], "text"):
                for doc, key, text in zip(*[part.column(k).to_pylist() for k in range(3)]):
                    for c, at in enumerate(range(0, len(text), chunk)):
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": [doc], "__tk": [key], "c": [c], "last": [at + chunk >= len(text)], "text": [text[at:at + chunk + overlap]]},
                            schema=pa.schema([("doc_id", pa.int64()), ("__tk", pa.int64()), ("c", pa.int32()), ("last", pa.bool_()), ("text", pa.string())]))
    return docs.mapInArrow(cut, "doc_id long, __tk long, c int, last boolean, text string").repartition("doc_id", "__tk", "c")


def _seams(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pre-token starts of each chunk near both of its seams, as positions in the text."""
    def starts(batches):
        import regex
        find = regex.compile(pattern).finditer
        for batch in batches:
            out = {"doc_id": [], "__tk": [], "c": [], "head": [], "tail": []}
            for doc, key, c, last, text in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                base, trusted = c * chunk, len(text) if last else len(text) - _LOOKAHEAD
                at = [m.start() for m in find(text)]
                at = [s for s in at[:None if last else -1] if s < trusted]
                for name, value in zip(out, (doc, key, c, [base + s for s in at if s < overlap], [base + s for s in at if s >= chunk])):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("doc_id", pa.int64()), ("__tk", pa.int64()), ("c", pa.int32()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))]))
    return chunks.mapInArrow(starts, "doc_id long, __tk long, c int, head array<long>, tail array<long>")


def _cuts(seams: DataFrame) -> DataFrame:
    """Places where a text may be cut: the first start that both neighbours of a seam have."""
    before = F.lag("tail").over(Window.partitionBy(*_ROW).orderBy("c"))
    met = seams.withColumn("before", before).withColumn("cut", F.array_min(F.array_intersect("head", "before")))
    return met.groupBy(*_ROW).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))


def _pieces(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for doc, key, text, places in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                ends = [*places, len(text)]
                for k, (a, b) in enumerate(zip([0, *places], ends)):
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": [doc], "__tk": [key], "piece": [k], "shared": [True], "text": [text[a:b]]},
                        schema=pa.schema([("doc_id", pa.int64()), ("__tk", pa.int64()), ("piece", pa.int32()), ("shared", pa.bool_()), ("text", pa.string())]))
    same = docs["doc_id"].eqNullSafe(cuts["doc_id"]) & (docs["__tk"] == cuts["__tk"])
    joined = docs.join(cuts, same).select(docs["doc_id"], docs["__tk"], "text", "cuts")
    return joined.mapInArrow(cut, "doc_id long, __tk long, piece int, shared boolean, text string").repartition("doc_id", "__tk", "piece")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, __tk, piece, shared, ids array<int>): the pieces in order make up the ids of the whole text.

    A text of at most ``chunk`` characters is one piece and is encoded where it lies; only longer ones are redistributed.
    A null text is an empty one: one piece without ids.  Rows with equal id and text share the pieces of one long
    text (``shared``; ``per_document`` gives each of them its result).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("__tk"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = rows.filter(F.length("text") > chunk).dropDuplicates(list(_ROW))
    cut = _pieces(long, _cuts(_seams(_chunks(long, chunk, overlap), pattern, chunk, overlap)))
    short = rows.filter(F.length("text") <= chunk).select(*_ROW, F.lit(0).alias("piece"), F.lit(False).alias("shared"), "text")

    def ids(batches):
        enc = encoding(path, pattern)
        for batch in slices(batches, "text", 1 << 20):
            values = [enc.encode_ordinary(text) for text in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(values, pa.list_(pa.int32()))],
                                             names=["doc_id", "__tk", "piece", "shared", "ids"])
    schema = "doc_id long, __tk long, piece int, shared boolean, ids array<int>"
    return short.mapInArrow(ids, schema).unionByName(cut.mapInArrow(ids, schema))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the bytes of each piece's ids, concatenated.

    A piece of an array that the encoder did not cut need not be valid UTF-8 by itself; bytes are never interpreted.
    """
    names = [f.name for f in encoded.schema]
    at = names.index("ids")

    def raw(batches):
        enc = encoding(path, pattern)
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            ids = batch.column(at)
            flat, ends = ids.values.to_numpy(), ids.offsets.to_pylist()
            values = [enc.decode_bytes(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=[*names, "decoded"])
    from pyspark.sql.types import BinaryType, StructField, StructType
    return encoded.mapInArrow(raw, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def per_document(docs: DataFrame, decoded: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    digests = decoded.select(*_ROW, "piece", "shared", F.size("ids").cast("long").alias("n_tokens"),
                             ids_text(F.col("ids")).alias("said"), F.col("decoded").cast("string").alias("raw"))

    def out(n, said, raw):
        return n.alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2(raw, 256).alias("decoded_sha256")

    whole = digests.filter("NOT shared").select(*_ROW, *out(F.col("n_tokens"), F.col("said"), F.col("raw")))
    parts = digests.filter("shared").groupBy(*_ROW).agg(
        F.sum("n_tokens").alias("n"), F.array_sort(F.collect_list(F.struct("piece", "said", "raw"))).alias("p"))
    joined = parts.select(*_ROW, *out(F.col("n"), F.array_join(F.filter("p.said", lambda x: x != ""), " "), F.array_join("p.raw", "")))
    rows = docs.filter(F.length(text_col) > chunk).select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("tk"))
    many = rows.join(joined, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("tk") == F.col("__tk"))).select(joined["*"])
    return whole.unionByName(many).drop("__tk")
