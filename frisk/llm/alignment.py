"""Alignment of two tokenizers' tokens over the bytes of each text.

The tokens of a block of documents are rows of two incidence matrices over the block's bytes (A: byte-level BPE, B: pieces), in
compressed rows built here by hand.  Gustavson's row products of A with the transpose of B add up the shared bytes of each pair of
tokens: the overlap links.  Byte offsets where tokens of both sides end cut the bytes into groups; the products of the
token-by-group matrices are the shared-group links.  Products run over blocks of rows with a bounded number of partial products.
Only those overlap links whose byte ranges end together count as links of the report; a group has one, its two last tokens.

``align`` does the tokenising once and stores a row per document with its links as (a, b, times).  Pair counts over the corpus are
one aggregation with map-side sums.  They come back to the documents by a broadcast while there are at most
``BROADCAST_PAIRS`` of them (counted first), beyond that by a shuffled join on the pair; both give the same rows.

Null and empty texts, and texts whose joined token bytes differ from space + text on either side, have no tokens.  Repeated
rows count once each; null document ids and clashing further columns do no harm; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.functions.keep import stored
from frisk.llm import rank_bpe
from frisk.llm.rows import slices

BROADCAST_PAIRS = 1_000_000  # 16 bytes each before hashing
_PARTIAL = 1 << 22  # partial products of a block of rows
SPACE = "▁"  # how pieces write a space


class Csr:
    """A sparse matrix of counts in compressed rows."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, counts: np.ndarray, width: int):
        self.starts, self.columns, self.counts, self.width = starts, columns, counts, width

    @classmethod
    def ones(cls, lengths: np.ndarray, columns: np.ndarray, width: int) -> Csr:
        return cls(np.concatenate([[0], np.cumsum(lengths)]).astype("int64"), columns, np.ones(len(columns), "int32"), width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.height), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")  # entries stay in row order inside a column
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))]), self.rows()[order], self.counts[order], self.height)

    def row_sizes(self, other: Csr) -> np.ndarray:
        """Partial products of each row of ``self`` times ``other``."""
        per_entry = np.diff(other.starts)[self.columns]
        return np.diff(np.concatenate([[0], np.cumsum(per_entry)])[self.starts])

    def blocks(self, other: Csr, most: int = _PARTIAL):
        """Gustavson's product ``self`` · ``other``: for each entry of a row, the matching row of ``other`` is added to the row's accumulator.

        Yields (rows, columns, counts) of a few rows at a time, in row order; a single row may exceed ``most``.
        """
        ends, first = np.cumsum(self.row_sizes(other)), 0
        while first < self.height:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
            a, b = self.starts[first], self.starts[last]
            inner = self.columns[a:b]
            many = other.starts[inner + 1] - other.starts[inner]
            total = int(many.sum())
            at = np.repeat(other.starts[inner] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total) if len(inner) else np.zeros(0, "int64")
            row = np.repeat(np.repeat(np.arange(first, last), np.diff(self.starts[first:last + 1])), many)
            key = row * other.width + other.columns[at]
            value = np.repeat(self.counts[a:b], many) * other.counts[at]
            if total and (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, "int64")
            yield key[new] // other.width, key[new] % other.width, np.add.reduceat(value, new) if total else value
            first = last


class Tokens:
    """The tokens of a block of documents on one side, with the block's byte offset at which each ends."""

    def __init__(self, ids: list[np.ndarray], bytes_of: np.ndarray):
        self.ids = np.concatenate([*ids, np.zeros(0, "int32")]).astype("int64")
        self.lengths = bytes_of[self.ids]
        self.ends = np.cumsum(self.lengths)
        self.doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])

    @property
    def size(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def bytes(self) -> Csr:
        return Csr.ones(self.lengths, np.arange(self.size), self.size)

    def groups(self, cuts: np.ndarray) -> Csr:
        return Csr.ones(np.ones(len(self.ids), "int64"), np.searchsorted(cuts, self.ends), len(cuts))


class Aligned:
    """Two sides over the same bytes."""

    def __init__(self, a: Tokens, b: Tokens):
        if a.size != b.size:
            raise ValueError("the sides differ in bytes")
        self.a, self.b = a, b
        self.cuts = np.intersect1d(a.ends, b.ends, assume_unique=True)
        self.group_a, self.group_b = a.groups(self.cuts), b.groups(self.cuts)

    def overlaps(self):
        """(token of A, token of B, shared bytes) of every pair that shares a byte."""
        return self.a.bytes().blocks(self.b.bytes().transposed())

    def shared_groups(self):
        """(token of A, token of B, 1) of every pair inside one group, a block at a time."""
        return self.group_a.blocks(self.group_b.transposed())

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The overlap links that end together."""
        found = [(i[same], j[same]) for i, j, _ in self.overlaps() for same in [self.a.ends[i] == self.b.ends[j]]]
        return tuple(np.concatenate([np.zeros(0, "int64"), *side]) for side in (zip(*found) if found else ((), ())))


class Pair:
    """Both tokenizers of a worker, with each id's bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.a, self.b = rank_bpe.tokenizer(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.a.bytes_of
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.apart = not any(SPACE in self.b.id_to_piece(k).lstrip(SPACE) for k in range(self.b.get_piece_size()))
        self.seen: dict[str, bytes | None] = {}
        self.length_a, self.length_b = (np.array([len(x) for x in side], "int64") for side in (self.bytes_a, self.bytes_b))
        # decimal ids with what follows them: inside a side, at a side's end
        sides = (len(self.bytes_a), "|"), (len(self.bytes_b), ";")
        self.table = np.array([text for size, mark in sides for k in range(size) for text in (f"{k},", f"{k}{mark}")], dtype=object)

    def _piece(self, k: int) -> bytes:
        if self.b.is_byte(k):
            return bytes([int(self.b.id_to_piece(k)[3:5], 16)])
        return self.b.id_to_piece(k).replace(SPACE, " ").encode()

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids on both sides; both empty where a side does not give the bytes of space + text.

        Side A spells every text.  No piece of B holds a space behind another character, so where spaces stand alone B's merges
        never pass one, and both sides work on the same cut pieces and remember them; other texts go to B's library whole.
        """
        ids_a, ids_b = ([np.zeros(0, "int32")] * len(texts) for _ in range(2))
        whole = {k: " " + t for k, t in enumerate(texts) if t}
        plain = {k: rank_bpe.cut(t) for k, t in whole.items() if self.apart and "  " not in t and SPACE not in t}
        self._learn({piece for pieces in plain.values() for piece in pieces})
        get = self.seen.__getitem__
        for (k, pieces), raw in zip(plain.items(), self.a.of_pieces(list(plain.values()))):
            found = list(map(get, pieces))
            if None not in found:
                ids_a[k], ids_b[k] = np.frombuffer(raw, "<i4"), np.frombuffer(b"".join(found), "<i4")
        rest = [k for k in whole if k not in plain]
        for k, a, b in zip(rest, self.a.encode([whole[k] for k in rest], plain=True), self.b.encode([texts[k] for k in rest], num_threads=1)):
            if self._spells(b, whole[k]):
                ids_a[k], ids_b[k] = a, np.array(b, "int32")
        return ids_a, ids_b

    def _spells(self, ids_b, text: str) -> bool:
        return b"".join(map(self.bytes_b.__getitem__, ids_b)) == text.encode()

    def _learn(self, pieces: set[str]) -> None:
        """Remember B's ids of pieces, which begin with a space; None where they do not spell the piece."""
        new = pieces.difference(self.seen)
        if len(self.seen) + len(new) > self.a.most:
            self.seen, new = {}, pieces
        if not new:
            return
        new = list(new)
        ids = self.b.encode([piece[1:] for piece in new], num_threads=1)
        flat = array("i", chain.from_iterable(ids))
        ends = np.cumsum([len(x) for x in ids])
        said = np.concatenate([[0], np.cumsum(self.length_b[np.frombuffer(flat, "i4")])])[ends]
        text = [piece.encode() for piece in new]
        if self._spells(flat, "".join(new)) and (said == np.cumsum([len(x) for x in text])).all():
            raw, ends = flat.tobytes(), (4 * ends).tolist()
            self.seen.update(zip(new, [raw[i:j] for i, j in zip([0, *ends], ends)]))
        else:
            self.seen.update((piece, array("i", x).tobytes() if self._spells(x, piece) else None) for piece, x in zip(new, ids))

    def group_texts(self, aligned: Aligned, n: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each of the block's ``n`` documents, read from the group-by-token matrices."""
        a, b = aligned.a, aligned.b
        members_a, members_b = aligned.group_a.transposed(), aligned.group_b.transposed()
        order_a, order_b = members_a.columns, members_b.columns
        last_a, last_b = np.zeros(len(order_a), "int64"), np.zeros(len(order_b), "int64")
        last_a[members_a.starts[1:] - 1], last_b[members_b.starts[1:] - 1] = 1, 1
        code = np.concatenate([2 * a.ids[order_a] + last_a, 2 * (len(self.bytes_a) + b.ids[order_b]) + last_b])
        # a group's tokens of A, then its tokens of B
        many_a, many_b = np.diff(members_a.starts), np.diff(members_b.starts)
        place_a = np.arange(len(order_a)) + np.repeat(members_b.starts[:-1], many_a)
        place_b = np.arange(len(order_b)) + np.repeat(members_a.starts[1:], many_b)
        laid = np.empty(len(code), "int64")
        laid[np.concatenate([place_a, place_b])] = code
        ends = np.cumsum(np.bincount(a.doc, minlength=n) + np.bincount(b.doc, minlength=n)).tolist()
        words = self.table[laid].tolist()
        return ["".join(words[i:j])[:-1] for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())])
_ROW = [("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("n_links", pa.int64()), ("n_shared", pa.int64()), ("groups", pa.string()), ("links", pa.list_(_LINK))]


def align_texts(both: Pair, texts: list[str | None]) -> dict:
    """Counts, group text and distinct links of each text; the texts are one block."""
    n = len(texts)
    ids_a, ids_b = both.tokens(texts)
    aligned = Aligned(Tokens(ids_a, both.length_a), Tokens(ids_b, both.length_b))
    a, b = aligned.a, aligned.b
    i, j = aligned.links()
    doc = a.doc[i]
    key = (doc * len(both.bytes_a) + a.ids[i]) * len(both.bytes_b) + b.ids[j]
    key, times = np.unique(key, return_counts=True)
    starts = np.searchsorted(key, np.arange(n + 1) * (len(both.bytes_a) * len(both.bytes_b)))
    rest, id_b = np.divmod(key, len(both.bytes_b))
    links = pa.StructArray.from_arrays([pa.array((rest % len(both.bytes_a)).astype("int32")), pa.array(id_b.astype("int32")), pa.array(times.astype("int32"))], fields=list(_LINK))
    first_of_group = np.searchsorted(a.ends, aligned.cuts)
    shared = np.bincount(a.doc, aligned.group_a.row_sizes(aligned.group_b.transposed()), n).astype("int64")
    return {"n_a": np.bincount(a.doc, minlength=n), "n_b": np.bincount(b.doc, minlength=n), "n_groups": np.bincount(a.doc[first_of_group], minlength=n),
            "n_links": np.bincount(doc, minlength=n), "n_shared": shared, "groups": both.group_texts(aligned, n),
            "links": pa.ListArray.from_arrays(pa.array(starts.astype("int32")), links)}


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(part, row, doc_id, n_a, n_b, n_groups, n_links, n_shared, groups, links array<(a, b, times)>), stored.

    (part, row) tells rows apart; ``n_shared`` counts the shared-group links; ``groups`` is the group text, or its SHA-256 with ``digest``
    ('' without tokens either way).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        both, part, seen = pair(path_a, path_b), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 1 << 20):
            n = batch.num_rows
            out = align_texts(both, batch.column(1).to_pylist())
            if digest:
                out["groups"] = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in out["groups"]]
            out |= {"part": np.full(n, part), "row": np.arange(seen, seen + n), "doc_id": batch.column(0)}
            seen += n
            yield pa.RecordBatch.from_arrays([v.cast(t) if isinstance(v := out[k], pa.Array) else pa.array(v, t) for k, t in _ROW], schema=pa.schema(_ROW))
    return stored(rows.mapInArrow(run, "part int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string, "
                                       "links array<struct<a: int, b: int, times: int>>"))


def token_links(docs: DataFrame, path_a: str, path_b: str, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, i, j, a, b, weight): every link of ``kind`` 'overlap' (weight: shared bytes) or 'group' between token i of A and token j of B."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if kind not in ("overlap", "group"):
        raise ValueError(f"no links of kind {kind!r}")

    def run(batches):
        both = pair(path_a, path_b)
        for batch in slices(batches, "text", 1 << 20):
            ids_a, ids_b = both.tokens(batch.column(1).to_pylist())
            aligned = Aligned(Tokens(ids_a, both.length_a), Tokens(ids_b, both.length_b))
            first_a, first_b = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]) for ids in (ids_a, ids_b))
            for i, j, weight in aligned.overlaps() if kind == "overlap" else aligned.shared_groups():
                doc = aligned.a.doc[i]
                for k in range(0, len(i), 50_000):
                    p, q, d = i[k:k + 50_000], j[k:k + 50_000], doc[k:k + 50_000]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), *[pa.array(v.astype("int32")) for v in (
                        p - first_a[d], q - first_b[d], aligned.a.ids[p], aligned.b.ids[q], weight[k:k + 50_000])]], names=["doc_id", "i", "j", "a", "b", "weight"])
    return rows.mapInArrow(run, "doc_id long, i int, j int, a int, b int, weight int")


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32) + b


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): links corpus-wide of each id pair, and whether the count is its B id's highest; stored."""
    links = aligned.select(F.explode("links").alias("l")).groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.sum("l.times").alias("count"))
    counts = stored(links)
    highest = counts.groupBy(F.col("b").alias("__b")).agg(F.max("count").alias("__most"))  # a row per B id: bounded by the vocabulary
    joined = counts.join(F.broadcast(highest), F.col("b") == F.col("__b"))
    return joined.select("a", "b", "count", (F.col("count") == F.col("__most")).alias("best"))


def report(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``aligned``: its counts, n_best and count_sum."""
    pairs = counts.select(_pair(F.col("a"), F.col("b")).alias("__pair"), F.col("count").alias("__count"), "best")
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        pairs = F.broadcast(pairs)
    own = ["part", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups"]
    rows = aligned.select(*own, F.explode_outer("links").alias("l")).select(*own, _pair(F.col("l.a"), F.col("l.b")).alias("__pair"), F.col("l.times").cast("long").alias("t"))
    joined = rows.join(pairs, "__pair", "left")
    return joined.groupBy(*own).agg(F.coalesce(F.sum(F.when(F.col("best"), F.col("t"))), F.lit(0)).alias("n_best"),
                                    F.coalesce(F.sum(F.col("t") * F.col("__count")), F.lit(0)).alias("count_sum"))


def per_document(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_shared of each row."""
    aligned = align(docs, path_a, path_b, digest=True)
    out = report(aligned, pair_counts(aligned))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"), "n_shared")
