"""Packing token sequences by minimum bin slack.

Documents become ids once; a document is cut into full windows and a rest, and each rest counts only as its length.  There
are at most ``capacity`` lengths, so the table of counts is small whatever the corpus: windows are planned on it.  A window
starts with the longest rest left; a subset-sum over a bitset of reachable sums finds the multiset of other rests that comes
closest to the capacity, and backtracking gives its counts.  A multiset that fills the window exactly is used as often as its
lengths last.  Lengths that no multiset completes are laid end to end and cut at the capacity, the tail at powers of two, so
that nothing is padded.  Ranks inside a length are counted per writing task and offset per (task, length): no length, however
common, meets in one task.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frisk.functions.keep import stored
from frisk.llm.rows import slices

CAPACITY, END_ID = 4096, 2
_PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long, part int, rank long"


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes, for a BPE file with word ends that drops white space.

    Words made of ASCII and Latin letters go through byte-pair merges by rank, where a word's end is one more byte that no
    UTF-8 text has; all others, and words that may hold a special token, go through the tokenizers library itself.  Both give
    the library's ids (tested).  The cache is emptied when it holds ``most`` words.
    """

    #: fixed values: the file's pre-token pattern and end-of-word mark
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END = "</w>"

    def __init__(self, path: str, most: int = 500_000):
        import regex
        from tokenizers import Tokenizer
        super().__init__()
        self.most, self.library = most, Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        special = set(self.library.get_added_tokens_decoder())
        to_byte = _byte_letters()
        ranks = {}
        for token, k in vocabulary.items():
            if k not in special:
                end = token.endswith(self.END)
                letters = token.removesuffix(self.END) if end else token
                ranks[bytes(to_byte[c] for c in letters) + b"\xff" * end] = k
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.find, self.plain = regex.compile(self.PATTERN).findall, re.compile("[!-~À-ÖØ-öø-ɏ]+").fullmatch

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain(text) and "<|" not in text:
            low = text.lower()
            parts = (low,) if low.isalpha() else self.find(low)
            ids = [k for part in parts for k in self.merge(part.encode() + b"\xff")]
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        if len(self) >= self.most:
            self.clear()
        self[word] = out = np.array(ids, "<u4").tobytes()
        return out

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow U+0100."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, part, rank), stored: full windows and the rest of each document with its end id.

    A null or empty text has the end id alone.  Repeated rows and null ids are documents of their own.
    """
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        ids_of, part, seen = word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, "int64")
        for batch in slices(batches, "text", 4 << 20):
            out = [[] for _ in range(7)]
            for doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                ids = ids_of.of(text) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    for column, value in zip(out, (doc, start, length, ids[4 * start:4 * (start + length)], n, part, int(seen[length]))):
                        column.append(value)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=[f.split()[0] for f in _PIECES.split(", ")])
    return stored(rows.mapInArrow(cut, _PIECES).withColumn("ids_crc32", F.crc32("ids")))


def fill(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The multiset with one ``seed`` whose sum comes closest to ``capacity``: length -> how many."""
    room = capacity - seed
    mask, reach, steps = (2 << room) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, lot = min(counts[length] - (length == seed), room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(lot, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, lot = left - take, 2 * lot
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Multisets that fill a window exactly with the number of windows of each, and the counts that no multiset completes."""
    left, windows, loose = {k: v for k, v in counts.items() if v > 0}, [], {}
    while left:
        seed = max(left)
        chosen = fill(left, seed, capacity)
        if sum(k * v for k, v in chosen.items()) < capacity:
            loose[seed] = left.pop(seed)  # what is left only shrinks, so this length stays incomplete
            continue
        times = min(left[k] // v for k, v in chosen.items())
        windows.append((chosen, times))
        for k, v in chosen.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return windows, loose


class Layout:
    """Where the piece of a given length and rank goes; its size depends on ``capacity``, not on the corpus."""

    def __init__(self, counts: dict[int, int], capacity: int):
        windows, loose = plan({k: v for k, v in counts.items() if k < capacity}, capacity)
        runs: dict[int, list] = {}
        used, base = {}, 0
        for chosen, times in windows:
            offset = 0
            for length, many in chosen.items():
                runs.setdefault(length, []).append((used.get(length, 0), base, many, offset))
                used[length] = used.get(length, 0) + many * times
                offset += length * many
            base += times
        self.capacity, self.used, self.base = capacity, used, base
        self.runs = {k: np.array(v, "int64") for k, v in runs.items()}
        self.loose, total = {}, 0
        for length in sorted(loose, reverse=True):
            self.loose[length] = total
            total += length * loose[length]
        tail = total % capacity
        cuts = [total - tail]
        for bit in reversed(range(tail.bit_length())):
            if tail >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
        self.cuts = cuts  # the last whole window's end, then each power of two
        self.full = base + total // capacity + len(cuts) - 1

    def places(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(from, tokens, sequence, offset) of each part of a piece; one part unless it is cut."""
        if length == self.capacity:
            return [(0, length, self.full + rank, 0)]
        if rank < self.used.get(length, 0):
            runs = self.runs[length]
            first, base, many, offset = runs[np.searchsorted(runs[:, 0], rank, "right") - 1].tolist()
            lot, copy = divmod(rank - first, many)
            return [(0, length, base + lot, offset + copy * length)]
        at = self.loose[length] + (rank - self.used.get(length, 0)) * length
        out, done = [], 0
        while done < length:
            pos = at + done
            if pos < self.cuts[0]:
                window, begin = divmod(pos, self.capacity)
                end, sequence = (window + 1) * self.capacity, self.base + window
            else:
                k = int(np.searchsorted(self.cuts, pos, "right")) - 1
                begin, end, sequence = pos - self.cuts[k], self.cuts[k + 1], self.base + self.cuts[0] // self.capacity + k
            take = min(length - done, end - pos)
            out.append((done, take, sequence, begin))
            done += take
        return out


_PLACES = "doc_id long, piece_start long, start long, length int, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, piece int, rank long, cut boolean"


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row per part of a piece with its sequence and offset; ids_crc32 is null where ``cut``."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    layout = Layout(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("part", "length").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = cut.join(offsets, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", (F.col("rank") + F.col("base")).alias("at"))

    def lay(batches):
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in _PLACES.split(", "))])
        for batch in batches:
            out = []
            for doc, start, length, crc, n, part, rank, at in zip(*[c.to_pylist() for c in batch.columns]):
                found = layout.places(length, at)
                out += [(doc, start, start + a, take, crc if len(found) == 1 else None, n, sequence, offset, part, length, rank, len(found) > 1)
                        for a, take, sequence, offset in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
    return ranked.mapInArrow(lay, _PLACES)


def with_ids(placed: DataFrame, cut: DataFrame) -> DataFrame:
    """``placed`` with the ids of each part (little-endian unsigned 32-bit)."""
    ids = cut.select("part", F.col("length").alias("piece"), "rank", F.col("ids").alias("__ids"))
    mine = F.expr("substring(__ids, cast(4 * (start - piece_start) + 1 as int), 4 * length)")
    return placed.join(ids, ["part", "piece", "rank"]).withColumn("ids", mine).drop("__ids")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece; an empty table packs to an empty one."""
    cut = pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    placed = stored(place(cut, capacity))
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    split = with_ids(placed.filter("cut"), cut).withColumn("ids_crc32", F.crc32("ids"))
    out = placed.filter("NOT cut").select(*columns).unionByName(split.select(*columns))
    return out.withColumn("length", F.col("length").cast("long"))


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each at most ``capacity`` ids."""
    cut = pieces(docs, tokenizer, capacity=capacity, end_id=end_id)
    parts = with_ids(stored(place(cut, capacity)), cut)
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return ordered.select("sequence_id", F.array_join(F.transform("p.ids", lambda b: b.cast("string")), "").cast("binary").alias("ids"))
