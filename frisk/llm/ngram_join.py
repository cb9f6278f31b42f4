"""Jaccard self-join of documents on word n-grams, by PartEnum signatures.

A document is the set of its n-gram hashes.  Sets are put into bands of nearly equal size; two sets that are similar enough lie
in the same or in adjacent bands, and their symmetric difference has at most k elements, where k follows from the band.  The
feature domain is cut into first-level parts, each into second-level parts; with n1 * (k2 + 1) > k at least one first-level part
sees k2 differences or fewer, so at least one subset of n2 - k2 of its n2 second-level parts sees none.  Every such subset is
one signature; sets that agree on one are candidates, and every candidate is verified on the sets themselves.

With spare parts linked sets agree on more than one signature.  Under one order of all signatures, by the number of documents that
have them, the first of t common ones has t - 1 common ones behind it in either set: each set leaves out its t - 1 most frequent
signatures and no link is lost.  What documents share that only hold the same passage mostly goes that way.

Signatures are dealt out by ranges of (signature, id), so a signature that very many documents share is spread over partitions.
Documents with one signature are not paired with each other when there are many of them.  All sets of such a bucket are written as differences D to
a reference set (what most of a few of them hold; any set is right).  Let m be the member with the smallest |D| - s|set|, s being the share
of both sizes that may differ.  All members that no links found so far connect with m are compared with it.  Two members that both link to
m are connected then; for any other pair |D(x)| + |D(y)| > s(|x| + |y|), so a link needs a common element of D(x) and D(y): those
elements are the buckets of the next level.  A pair is left out only if links found so far, of whatever bucket and level, connect
the two (their components are kept up to date level by level), and a bucket only if they connect all of it.  D is split into added (A) and removed (R) elements; a pair without a common added element needs
|A(x)| + |A(y)| + ||R(x)| - |R(y)|| <= s(|x| + |y|), so with d the smallest |A| - |R| of the bucket, only members with
|D| + d <= s(|x| + |y|) have to be looked up by removed elements, and only by a prefix of them.  Added elements are a prefix too: y
lacks at most the share of x that linked sets may lack, so one more of A(x) in one order holds the first common one.  Buckets of later levels are paired up
to a fixed size, their sketches compared inside the join, so only pairs that can link leave it.  No candidate is capped or skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frisk.functions.keep import Scratch, stored
from frisk.llm.components import components
from frisk.llm.rows import slices

SPARE, SPARE_SHARE = 2, 8  # spare parts: so many at least, one for so many elements of difference
BROADCAST_IDS = 1_000_000  # 16 bytes each
SMALL, REFERENCE_ROWS = 12, 16  # buckets up to SMALL members are paired directly; about so many rows vote on a reference set
PAIRED = 512  # and those of later levels up to so many, by their sketches inside the join


@dataclass(frozen=True)
class Similarity:
    """Sets are linked when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    k2: int = 1
    n2: int = 2

    @property
    def differ(self) -> tuple[int, int]:
        """The share of both sizes that linked sets may differ in, as a fraction."""
        return 100 - self.percent, 100 + self.percent

    def most_different(self, sizes: int) -> int:
        a, b = self.differ
        return sizes * a // b

    def band(self, size: int) -> tuple[int, int, int]:
        """(number of the band, its largest size, the largest size of the next band)."""
        return _bands(self.percent, 1 << size.bit_length())[size]


@lru_cache(maxsize=64)
def _bands(percent: int, upto: int) -> dict[int, tuple[int, int, int]]:
    ends, low = [], 1
    while low <= upto or len(ends) < 2 or ends[-2] < upto:
        ends.append(max(low, low * 100 // percent))
        low = ends[-1] + 1
    out, low = {}, 1
    for k in range(len(ends) - 1):
        for size in range(low, min(ends[k], upto) + 1):
            out[size] = (k, ends[k], ends[k + 1])
        low = ends[k] + 1
    return out


# --- hashing -------------------------------------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift-multiply rounds)."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHash()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text is one gram, a text without words none."""
    words = (text or "").encode().lower().split()  # both act on ASCII alone
    if not words:
        return np.empty(0, "uint64")
    h = np.fromiter(map(_WORDS.__getitem__, words), "uint64", len(words))
    grams = np.full(max(1, len(h) - n + 1), min(n, len(h)), "uint64")
    for k in range(min(n, len(h))):
        grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(grams)], k + 1)
    return np.unique(grams)


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of the set, whatever its order."""
    return tuple(int(_mix(grams, seed).sum(dtype="uint64").astype("int64")) for seed in (11, 12))


def signatures(grams: np.ndarray, rule: Similarity) -> np.ndarray:
    """The set's signatures for its own band and for the next one; the last bit of each tells the two apart."""
    return _signatures(grams, rule)[0]


def _signatures(grams: np.ndarray, rule: Similarity) -> tuple[np.ndarray, list[int]]:
    """Signatures, and by their last bit how many of them a linked set shares beyond the first.

    Where subsets are single second-level parts there are spare parts, more than needed, so linked sets agree on more parts than
    are spare.  Parts without an element say nothing and are left out by sets that have no more of them than are spare:
    such a set agrees with every linked one on a part that has elements, and on the spare ones more less its empty ones.
    Spare parts grow with the difference: a long text holds many parts that one common passage decides.
    """
    number, own, following = rule.band(len(grams))
    scrambled, weights = _mix(grams, 21), _mix(grams, 22)
    out, surplus = [], [0, 0]
    for instance, largest in ((number, own), (number + 1, following)):
        k, last = rule.most_different(2 * largest), np.uint64(instance & 1)
        if k == 0:
            out.append(_mix(weights.sum(dtype="uint64", keepdims=True), 40 + instance) & ~np.uint64(1) | last)
            continue
        single = rule.n2 == rule.k2 + 1
        spare = max(SPARE, k // SPARE_SHARE) if single else SPARE
        n1 = -(-(k + 1 + spare * single) // (rule.k2 + 1))
        k2 = rule.k2 if single else -(-(k + 1) // n1) - 1
        n2 = rule.n2 if k2 == rule.k2 else k2 + 1
        cell = ((scrambled >> np.uint64(40)) % np.uint64(n1) * np.uint64(n2) + (scrambled & np.uint64(0xFFFFFF)) % np.uint64(n2)).astype("int64")
        sums, held = np.zeros(n1 * n2, "uint64"), np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        np.add.at(sums, cell, weights)
        grid = sums.reshape(n1, n2)
        empty = int((held == 0).sum())
        drop_empty = n2 == k2 + 1 and n1 * n2 > k + spare and empty <= spare
        if drop_empty and single:
            surplus[instance & 1] = spare - empty
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            total = _mix(np.arange(n1, dtype="uint64") + np.uint64(((instance + 1) << 40) + (c << 32)), 23)
            for part in chosen:
                total = _mix(total + grid[:, part], 24 + part)
            out.append((total[held[:, chosen].sum(axis=1) > 0] if drop_empty else total) & ~np.uint64(1) | last)
    return np.concatenate(out).astype("int64"), surplus


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes in a power of two of bits, one to two bits an element, as 64-bit words.

    Two sketches differ in no more bits than their sets differ in elements, so a difference that is too large rules a pair out.
    """
    bits = max(64, 1 << len(grams).bit_length())
    odd = np.bincount((_mix(grams, 31) & np.uint64(bits - 1)).astype("int64"), minlength=bits) & 1
    return np.packbits(odd.astype("uint8"), bitorder="little").view("int64")


# --- stages --------------------------------------------------------------------------------

_BASE = "id long, n long, h1 long, h2 long, sigs array<long>, surplus array<int>, sketch array<long>"


def signed(docs: DataFrame, rule: Similarity, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, n, h1, h2, sigs, surplus, sketch) per row, written; sets that a task has seen before have no signatures again, their hashes tell them."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        seen = set()
        for batch in slices(batches, "text", 4 << 20):
            out, flat, ends, over, sketches = [[] for _ in range(4)], [np.empty(0, "int64")], [0], [], []
            for i, text in zip(*[c.to_pylist() for c in batch.columns]):
                grams = shingles(text, rule.words)
                key = (len(grams), *set_hash(grams))
                if len(grams) and i is not None and key not in seen:
                    seen.add(key)
                    found, surplus = _signatures(grams, rule)
                    flat.append(found)
                    over.append(surplus)
                    ends.append(ends[-1] + len(found))
                else:
                    over.append(None)
                    ends.append(ends[-1])
                sketches.append(sketch(grams))
                for column, value in zip(out, (i, *key)):
                    column.append(value)
            sigs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out), sigs, pa.array(over, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))],
                                             names=["id", "n", "h1", "h2", "sigs", "surplus", "sketch"])
    return scratch.keep(rows.mapInArrow(run, _BASE))


def _shared(sigs: DataFrame) -> DataFrame:
    """Rows (b, id) whose signature a neighbour has, by a stream over ranges of (b, id); rows at a range's ends stay.

    A range holds a bounded number of rows whatever their signatures, and the stream holds one batch.
    """
    ranged = sigs.repartitionByRange("b", "id").sortWithinPartitions("b", "id")

    def run(batches):
        held, first = None, True  # the last row waits for its successor
        for batch in batches:
            if not batch.num_rows:
                continue
            b, i = (c.to_numpy() for c in batch.columns)
            if held is not None:
                b, i = np.append(held[0], b), np.append(held[1], i)
            same = b[1:] == b[:-1]
            keep = np.append(same, False) | np.append(False, same)
            keep[0] |= first or bool(held is not None and held[2])
            first = False
            out = keep[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(b[:-1][out]), pa.array(i[:-1][out])], names=["b", "id"])
            held = b[-1:], i[-1:], bool(keep[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["b", "id"])
    return ranged.mapInArrow(run, "b long, id long")


def _sets(docs: DataFrame, ids: DataFrame, rule: Similarity, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, n, grams) of the documents in ``ids``, written.  Ids are broadcast up to ``BROADCAST_IDS``, counted before; beyond that texts are shuffled."""
    ids = scratch.keep(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, "id", "left_semi")

    def run(batches):
        for batch in slices(batches, "text", 4 << 20):
            grams = [shingles(t, rule.words).astype("int64") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, grams), pa.int64()), pa.array(grams, pa.list_(pa.int64()))], names=["id", "n", "grams"])
    return scratch.keep(rows.mapInArrow(run, "id long, n long, grams array<long>"))


def _bits_apart(x: str, y: str) -> Column:
    """In how many bits two sketches differ; the longer one is folded (sizes of candidates differ by a factor of two at most)."""
    def fold(mine, other):
        half = F.size(other)
        return F.when(F.size(mine) > half, F.zip_with(F.slice(mine, 1, half), F.slice(mine, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(mine))
    return F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, v: t + v)


def _plausible(rule: Similarity) -> Column:
    """Whether sizes (nx, ny) and sketches (sx, sy) leave the pair possible."""
    a, b = rule.differ
    near = F.least("nx", "ny") * 100 >= rule.percent * F.greatest("nx", "ny")
    # sizes further apart could not be folded onto each other, hence the condition inside the expression
    return F.when(near & (F.size("sx") <= 2 * F.size("sy")) & (F.size("sy") <= 2 * F.size("sx")),
                  b * _bits_apart("sx", "sy") <= a * (F.col("nx") + F.col("ny"))).otherwise(near)


def _possible(pairs: DataFrame, sketches: DataFrame, rule: Similarity) -> DataFrame:
    """``pairs`` (x, y) that their sizes and sketches do not rule out."""
    both = pairs
    for c in "xy":
        both = both.join(sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    return both.filter(_plausible(rule)).select("x", "y")


def _linked(pairs: DataFrame, sets: DataFrame, rule: Similarity) -> DataFrame:
    """The ``pairs`` (x, y) that pass the exact test on both sets."""
    def side(c):
        return sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("grams").alias(f"g{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    common = F.size(F.array_intersect("gx", "gy"))
    return both.filter(100 * common >= rule.percent * (F.col("nx") + F.col("ny") - common)).select("x", "y")


def _own() -> Column:
    """The component a member is in by the links found so far; one without a link is its own, stored as null."""
    return F.coalesce("component", "id")


def _parted() -> Column:
    return F.min(_own()) < F.max(_own())


def _direct(buckets: DataFrame) -> DataFrame:
    """Pairs (x, y), x < y, of small buckets that are not connected yet."""
    members = buckets.select("b", "id", _own().alias("c"))
    other = members.select("b", F.col("id").alias("y"), F.col("c").alias("cy"))
    pairs = members.withColumnRenamed("id", "x").join(other, "b").filter("x < y AND c <> cy")
    return pairs.select("x", "y").distinct()


def _near(buckets: DataFrame, sketches: DataFrame, rule: Similarity) -> DataFrame:
    """Pairs (x, y), x < y, of buckets of later levels that are not connected yet and that sketches, carried into the join, do not rule out."""
    members = buckets.select("b", "id", _own().alias("c")).join(sketches, "id")
    def side(v):
        return members.select("b", F.col("id").alias(v), F.col("c").alias(f"c{v}"), F.col("n").alias(f"n{v}"), F.col("sketch").alias(f"s{v}"))
    pairs = side("x").join(side("y").withColumnRenamed("b", "b2"), (F.col("b") == F.col("b2")) & (F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & _plausible(rule))
    return pairs.select("x", "y").distinct()


def _connected(known: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) by the links behind ``known`` and by ``pairs`` (x, y)."""
    own = Scratch(known.sparkSession)
    links = known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))
    out = scratch.keep(components(links, own))
    own.clear()
    return out


def _small(table: DataFrame, weight: Column | None = None) -> DataFrame:
    """``table``, broadcast where its rows (or their ``weight``) are few, counted before: a join by group then leaves the rows of a large group where they are."""
    held = table.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(table) if held <= BROADCAST_IDS else table


def _reference(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(p, reference): what most of about ``REFERENCE_ROWS`` members hold."""
    size = large.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    lot = F.greatest(F.lit(1), F.floor(F.col("n") / REFERENCE_ROWS))
    voters = large.join(size, "p").filter(F.pmod(F.xxhash64("p", "id"), lot) == 0).select("p", "id")

    def vote(key: tuple, table: pa.Table) -> pa.Table:
        arrays = table.column("grams").combine_chunks()
        values, counts = np.unique(arrays.flatten().to_numpy(), return_counts=True)
        return pa.table({"p": pa.array([key[0].as_py()], pa.int64()), "reference": pa.array([values[2 * counts > len(arrays)]], pa.list_(pa.int64()))})
    return voters.join(sets.select("id", "grams"), "id").groupBy("p").applyInArrow(vote, "p long, reference array<long>")


def _next_level(large: DataFrame, linked: DataFrame, known: DataFrame, sets: DataFrame, rule: Similarity, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``known`` with this level's links, those with the middle member of each large bucket too, and the next level's buckets (b, id, component)."""
    a, b = rule.differ
    large = scratch.keep(large.select("p", "id", "component").distinct())  # groups, see _counted
    votes = scratch.keep(_reference(large, sets).withColumn("g", F.xxhash64("reference")))
    refs = votes.groupBy("g").agg(F.first("reference").alias("reference"))  # and so are those with one reference
    # a group without a voter has the empty reference
    none = F.coalesce(F.col("g"), F.lit(0))
    group = scratch.keep(large.join(_small(votes.select("p", "g")), "p", "left").select(none.alias("g"), "id", "component").distinct())
    held = group.join(sets, "id").join(_small(refs, 2 + F.size("reference")), "g", "left").withColumn("reference", F.coalesce("reference", F.array().cast("array<long>")))
    added, removed = F.array_except("grams", "reference"), F.array_except("reference", "grams")
    diff = scratch.keep(held.select("g", "id", "component", "n", added.alias("added"), removed.alias("removed")))
    na, nr, n = F.size("added"), F.size("removed"), F.col("n")
    nearest = F.min(F.struct((b * (na + nr) - a * n).alias("f"), F.col("id").alias("m"), _own().alias("c")))
    middle = _small(scratch.keep(diff.groupBy("g").agg(nearest.alias("best"), F.min(na - nr).alias("d")).select("g", "best.m", "best.c", "d")))
    centre = diff.join(middle, "g").filter("id = m").groupBy("g").agg(*[F.first(k).alias(f"{k}_m") for k in ("n", "added", "removed")])
    centre = _small(scratch.keep(centre), 3 + F.size("added_m") + F.size("removed_m"))
    # what a member and the middle differ in is what their differences to the reference differ in
    apart = (F.size("added_m") + F.size("removed_m") + na + nr - 2 * F.size(F.array_intersect("added", "added_m")) - 2 * F.size(F.array_intersect("removed", "removed_m")))
    both = n + F.col("n_m")
    star = diff.join(middle, "g").filter((F.col("id") != F.col("m")) & (_own() != F.col("c"))).join(centre, "g").filter(b * apart <= a * both)
    new = linked.unionByName(scratch.keep(star.select(F.col("id").alias("x"), F.col("m").alias("y")).distinct()))
    if not new.isEmpty():
        known = _connected(known, new, scratch)
    # the middle itself needs no further test: all others are compared or connected with it
    rows = diff.drop("component").join(middle, "g").filter("id <> m").join(known, "id", "left")
    most = F.floor(a * (n + F.floor(n * 100 / rule.percent)) / b).cast("int")  # that any partner may differ by
    lost = F.floor(n * (100 - rule.percent) / 100).cast("int")  # elements of its own that any partner may lack
    # partners hold n less those at least, so their |A| - |R| is no less than that of such a size
    reach = na + nr + F.greatest("d", na - nr - lost) <= most
    # without a common added element |D| - most removed ones are common, so a prefix of the others and one more holds one of them
    some = F.slice("removed", 1, F.greatest(F.lit(0), F.least(nr, most - na + 1)))
    first = F.slice("added", 1, lost + 1)
    keys = F.concat(F.transform(first, lambda e: F.xxhash64("g", F.lit(1), e)),
                    F.when(reach, F.transform(some, lambda e: F.xxhash64("g", F.lit(2), e))).otherwise(F.array().cast("array<long>")))
    live = _small(rows.groupBy("g").agg(_parted().alias("parted")).filter("parted").select("g"))  # groups whose members are all connected are done
    sub = rows.join(live, "g", "left_semi").select(F.explode(F.array_distinct(keys)).alias("b"), "id", "component")
    return known, sub.distinct()


def _counted(buckets: DataFrame, scratch: Scratch, top: bool = False) -> DataFrame:
    """Buckets whose members are not all connected yet, with their size and p, by which large ones are joined into groups.

    Signatures of one family of documents overlap almost fully, so those with the same smallest member are one group.  Buckets of
    later levels stay apart: joining them would undo the division.
    """
    size = scratch.keep(buckets.groupBy("b").agg(F.count(F.lit(1)).alias("members"), _parted().alias("parted"), (F.min("id") if top else F.col("b")).alias("p")).filter("parted").drop("parted"))
    return scratch.keep(buckets.join(size, "b"))


def _selective(buckets: DataFrame, surplus: DataFrame) -> DataFrame:
    """``buckets`` (b, id) of two members or more without each set's most frequent signatures, as many as ``surplus`` (id, surplus) says.

    Signatures are ordered by members and value.  A set's signatures of one band are one window, bounded by its own text.
    """
    size = buckets.groupBy("b").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    last = F.col("b").bitwiseAND(1).cast("int")
    place = F.row_number().over(Window.partitionBy("id", last).orderBy(F.desc("members"), F.desc("b")))
    rows = buckets.join(size, "b").withColumn("place", place).join(surplus, "id")
    return rows.filter(F.col("place") > F.col("surplus")[last]).select("b", "id")


def links(docs: DataFrame, base: DataFrame, classes: DataFrame, rule: Similarity, id_col: str, text_col: str, scratch: Scratch, selective: bool = False) -> DataFrame:
    """(a, b) between representatives of different sets: enough of them to connect every pair that is similar enough.

    ``selective`` leaves each set's ``surplus`` most frequent signatures out; it needs all signatures of ``signed``.
    """
    shared = scratch.keep(_shared(base.select(F.explode("sigs").alias("b"), "id")))
    wanted = shared.select("id").distinct()
    names = scratch.keep(base.select("id", "n", "h1", "h2", "surplus", "sketch").join(wanted, "id", "left_semi").join(classes, ["n", "h1", "h2"]).select("id", "rep", "n", "surplus", "sketch"))
    sketches = scratch.keep(names.select(F.col("rep").alias("id"), "n", "sketch").distinct())
    buckets = scratch.keep(shared.join(names.select("id", "rep").distinct(), "id").select("b", F.col("rep").alias("id")).distinct())
    if selective:
        surplus = names.filter("surplus IS NOT NULL").select(F.col("rep").alias("id"), "surplus").distinct()
        buckets = scratch.keep(_selective(buckets, surplus))
    buckets = buckets.withColumn("component", F.lit(None).cast("long"))
    buckets = _counted(buckets, scratch, top=True)
    none = base.sparkSession.createDataFrame([], "id long, component long")
    known, last, sets = none, none.select(F.col("id").alias("x"), F.col("component").alias("y")), None
    while not buckets.isEmpty():
        most = SMALL if sets is None else PAIRED
        few = buckets.filter(F.col("members") <= most)
        pairs = scratch.keep(_possible(_direct(few), sketches, rule) if sets is None else _near(few, sketches, rule))
        large = buckets.filter(F.col("members") > most)
        if sets is None:  # later levels hold no other documents than this one's large buckets
            ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).union(large.select("id")).distinct()
            sets = _sets(docs, ids, rule, id_col, text_col, scratch)
        linked = scratch.keep(_linked(pairs, sets, rule))
        if large.isEmpty():
            last = linked
            break
        known, below = _next_level(large, linked, known, sets, rule, scratch)
        buckets = _counted(scratch.keep(below), scratch)
    return known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(last.select(F.col("x").alias("a"), F.col("y").alias("b")))


def jaccard_groups(docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: documents connected by links have the smallest id of their component.

    A text without words has an empty set and is linked with nothing.  Rows without an id link with nothing and have no
    component.  Repeated rows, and rows that share an id, are one document.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    base = signed(docs, rule, id_col, text_col, scratch)
    some = base.filter("n > 0 AND id IS NOT NULL")
    classes = scratch.keep(some.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")))
    same = some.join(classes, ["n", "h1", "h2"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = links(docs, some, classes, rule, id_col, text_col, scratch, selective=True).unionByName(same)
    out = base.select("id", "n").join(components(found, scratch), "id", "left")
    out = stored(out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))
    scratch.clear()
    return out
