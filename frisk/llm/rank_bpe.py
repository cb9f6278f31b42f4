"""Byte-level BPE by contiguous rank arrays, for a tokenizers file with ranked merges.

A text is cut before every single space that a visible character follows: no pre-token spans such a place, so each cut piece has
the same ids wherever it stands, and a worker remembers those of recent pieces.  Pieces not seen yet are split into pre-tokens;
pre-tokens of equal length form one block, a row each: the parts between the boundaries that are left, and the ranks of
adjacent parts.  Each round scans every row for its first smallest rank, deletes that boundary and refreshes the ranks
to its left and right; a row without a rank left is done.  All rows of a block lose one boundary a round, so both arrays stay
contiguous.  A pre-token of more than ``SHORT`` bytes, where repeated scans would be quadratic, keeps its boundaries in a linked
list and its ranks in a heap instead; both give the same ids.

Special tokens stand for themselves unless ``plain`` asks for ordinary text.  Null text is empty; empty texts have no ids; repeated
rows, null document ids and further columns pass through untouched; an empty table stays empty.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from frisk.llm.rows import slices

SHORT = 64  # bytes up to which a word is a row of a rank array
_NONE = np.int64(1) << 40
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]*)(\n?)").fullmatch  # the usual piece: its pre-tokens are these groups
_CUT = re.compile(r"(?= \S)")  # this \S never matches white space of the pattern below (it excludes U+001C to U+001F as well)

cut = _CUT.split

#: fixed value: the pattern by which byte-level files split text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters by which such files write bytes: printable ones stand for themselves, the others follow U+0100."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class RankBpe:
    """Vocabulary and merges of one file.  ``most`` bounds the remembered pieces, and words, which are forgotten together when it is reached."""

    def __init__(self, path: str, most: int = 500_000):
        import regex
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, split = data["model"], data["pre_tokenizer"]
        if (data["normalizer"], split["type"], split["add_prefix_space"], model["type"]) != (None, "ByteLevel", False, "BPE") or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE file without a normalizer")
        vocabulary, letters = model["vocab"], byte_letters()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else lambda t: [t]
        self.size = 1 + max([*vocabulary.values(), *special.values()])
        self.bytes_of = [b""] * self.size
        for token, k in (vocabulary | special).items():
            known = all(c in letters for c in token)
            self.bytes_of[k] = bytes(letters[c] for c in token) if known else token.encode()
        self.byte_id = np.zeros(256, "int64")
        for letter, b in letters.items():
            self.byte_id[b] = vocabulary[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], "int64")
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], "int64")  # by rank; its bytes are those of its parts, so ids always spell their text
        order = keys.argsort()
        self.keys, self.rank_of = keys[order], order.astype("int64")
        self.ranks_by_key = None
        self.most, self.seen, self.known, self.find = most, {"": b""}, {}, regex.compile(PATTERN).findall

    # ranks

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; _NONE where no merge joins them."""
        wanted = left * self.size + right
        at = np.minimum(self.keys.searchsorted(wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of[at], _NONE)

    def block(self, words: np.ndarray) -> list[bytes]:
        """Ids (little-endian 32-bit) of words of one length: ``words`` is one row of byte values a word."""
        out: list[bytes] = [b""] * len(words)
        parts = self.byte_id[words]
        ranks, row = self.ranks(parts[:, :-1], parts[:, 1:]), np.arange(len(words))
        while len(row):
            width = parts.shape[1]
            if width > 1:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(row)), at]
                done = best == _NONE
            else:
                done = np.ones(len(row), bool)
            if done.any():
                said, step = parts[done].astype("<i4").tobytes(), 4 * width
                for k, r in enumerate(row[done].tolist()):
                    out[r] = said[k * step:(k + 1) * step]
                if done.all():
                    break
                live = ~done
                parts, ranks, row, at, best = parts[live], ranks[live], row[live], at[live], best[live]
            every = np.arange(len(row))
            parts[every, at] = self.merged[best]
            stay = np.ones(parts.shape, bool)
            stay[every, at + 1] = False
            parts = parts[stay].reshape(len(row), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[every, at] = False
            ranks = ranks[stay].reshape(len(row), width - 2)
            for side in (at - 1, at):  # the neighbours of the deleted boundary
                k = np.flatnonzero((side >= 0) & (side < width - 2))
                ranks[k, side[k]] = self.ranks(parts[k, side[k]], parts[k, side[k] + 1])
        return out

    @property
    def table(self) -> dict[int, int]:
        if self.ranks_by_key is None:
            self.ranks_by_key = dict(zip(self.keys.tolist(), self.rank_of.tolist()))
        return self.ranks_by_key

    def long_word(self, word: bytes) -> bytes:
        """The same for one long word: boundaries as a linked list, ranks as a heap (rank, then place)."""
        table, size, merged = self.table, self.size, self.merged
        ids = self.byte_id[np.frombuffer(word, "uint8")].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := table.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two parts is gone or has grown
            ids[i], ids[j] = int(merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := table.get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (s := table.get(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return np.array([k for k in ids if k >= 0], "<i4").tobytes()

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens."""
        out, by_length = {}, {}
        for word in words:
            raw = word.encode()
            if len(raw) > SHORT:
                out[word] = self.long_word(raw)
            else:
                by_length.setdefault(len(raw), []).append((word, raw))
        for n, rows in by_length.items():
            for k in range(0, len(rows), 8192):
                some = rows[k:k + 8192]
                values = np.frombuffer(b"".join(raw for _, raw in some), "uint8").reshape(len(some), n)
                out.update(zip((word for word, _ in some), self.block(values)))
        return out

    # texts

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of ``pieces``, of which none is remembered yet."""
        fresh, new = {}, set()
        for piece in pieces:
            m = _PLAIN(piece)
            fresh[piece] = words = [w for w in m.groups() if w] if m else self.find(piece)
            new.update(words)
        new.difference_update(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, {word for words in fresh.values() for word in words}
        self.known.update(self.words(list(new)))
        get, seen = self.known.__getitem__, self.seen
        for piece, words in fresh.items():
            seen[piece] = get(words[0]) if len(words) == 1 else b"".join(map(get, words))

    def of_pieces(self, texts: list[list[str]]) -> list[bytes]:
        """Ids (little-endian 32-bit) of texts given as cut pieces."""
        new = {piece for text in texts for piece in text}
        every = len(new)
        new.difference_update(self.seen)
        if len(self.seen) + len(new) > self.most:
            self.seen = {"": b""}
            if every > len(new):
                new = {piece for text in texts for piece in text if piece}
        if new:
            self.learn(new)
        get = self.seen.__getitem__
        return [b"".join(map(get, text)) for text in texts]

    def encode(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        """Ids of each text as the tokenizers library gives them without added special tokens."""
        parts = [[text] if plain else self.split_special(text) for text in texts]  # text, special, text, ...
        raw = iter(self.of_pieces([cut(part) for text in parts for part in text[::2]]))
        out = []
        for text in parts:
            ids = next(raw)
            for special in text[1::2]:
                ids += self.special[special].to_bytes(4, "little") + next(raw)
            out.append(np.frombuffer(ids, "<i4"))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, ids beyond the vocabulary nothing."""
        try:
            raw = b"".join(map(self.bytes_of.__getitem__, ids))
        except IndexError:
            raw = b"".join([self.bytes_of[k] for k in ids if k < self.size])
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> RankBpe:
    """One per Python worker and file."""
    return RankBpe(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", plain: bool = False) -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>) in place of ``text_col``; no shuffle, whole texts, batches bounded by bytes."""
    rows = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    at = rows.columns.index(text_col)
    fields = [StructField(ids_col, ArrayType(IntegerType())) if k == at else f for k, f in enumerate(rows.schema.fields)]

    def run(batches):
        bpe = tokenizer(path)
        for batch in slices(batches, text_col, 1 << 20):
            ids = bpe.encode(batch.column(at).to_pylist(), plain)
            ends = np.cumsum([0, *map(len, ids)], dtype="int32")
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, "int32")])))
            yield pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(batch.columns)], names=[f.name for f in fields])
    return rows.mapInArrow(run, StructType(fields))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``text_col``; null ids have null text."""
    at = encoded.columns.index(ids_col)
    names = [*encoded.columns, text_col]

    def run(batches):
        bpe = tokenizer(path)
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            texts = [None if ids is None else bpe.decode(ids.values.to_numpy(zero_copy_only=False).tolist()) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(text_col, StringType())]))


def per_document(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = decode(encode(rows, path), path)
    said = F.array_join(F.transform("ids", lambda k: k.cast("string")), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
