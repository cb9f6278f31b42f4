"""Exclusive running folds per key that survive hot keys and whole-table orders.

A plain ``Window.partitionBy(key)`` puts one key in one task.  Here a key with more than
``hot_rows`` rows is cut into time chunks: the window runs inside (key, chunk), the chunk
totals (one row per chunk, partially aggregated) are folded over the chunks, and the carry
is added back.  Keys that are not hot keep chunk NULL and pay nothing but an empty join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
BROADCAST_KEYS = 20_000  # a hot-key list beyond this is joined by shuffle instead
_LEAST_MARKS = 128


@dataclass(frozen=True)
class Fold:
    name: str
    op: str  # sum | max | min | last | moments: (n, mean, m2), m2 the sum of squared deviations from the mean
    value: Column  # NULL = the row does not take part

    def _moments(self, over=lambda c: c) -> Column:
        n = over(F.count(self.value))
        return F.struct(n.alias("n"), over(F.avg(self.value)).alias("mean"), (over(F.var_pop(self.value)) * n).alias("m2"))

    def agg(self) -> Column:
        if self.op == "moments":
            return self._moments()
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.op](self.value)

    def over(self, w) -> Column:
        if self.op == "last":
            return F.last(self.value, ignorenulls=True).over(w)
        if self.op == "moments":
            return self._moments(lambda c: c.over(w))
        return self.agg().over(w)

    def total(self, order: Column) -> Column:
        if self.op == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), order))
        return self.agg()

    def prepare(self, totals: DataFrame, w) -> DataFrame:
        """Totals as ``carry`` sums them.  A chunk's share in the joint m2 is its own plus the gap between its mean and that of all
        chunks before: only terms of one sign, so nothing cancels however far the chunks lie apart."""
        if self.op != "moments":
            return totals
        n, mean = F.col(self.name + ".n"), F.col(self.name + ".mean")
        totals = totals.withColumns({"_n": F.sum(n).over(w), "_s": F.sum(n * mean).over(w)})
        gap = F.when((F.col("_n") > 0) & (n > 0), F.pow(mean - F.col("_s") / F.col("_n"), F.lit(2.0)) * F.col("_n") * n / (F.col("_n") + n)).otherwise(0.0)
        return totals.withColumn(self.name, F.struct(n.alias("n"), (n * mean).alias("s"), (F.coalesce(F.col(self.name + ".m2"), F.lit(0.0)) + gap).alias("m2"))).drop("_n", "_s")

    def carry(self, w) -> Column:
        c = F.col(self.name)
        if self.op == "moments":
            n = F.sum(c["n"]).over(w)
            return F.when(n > 0, F.struct(n.alias("n"), (F.sum(c["s"]).over(w) / n).alias("mean"), F.sum(c["m2"]).over(w).alias("m2")))
        if self.op == "last":
            return F.last(c, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.op](c).over(w)

    def join(self, carried: Column, inside: Column) -> Column:
        if self.op == "sum":
            return F.when(carried.isNull(), inside).when(inside.isNull(), carried).otherwise(carried + inside)
        if self.op == "last":
            return F.coalesce(inside, carried)
        if self.op == "moments":
            a, b = carried, inside
            n = a["n"] + b["n"]
            both = F.struct(n.alias("n"), ((a["n"] * a["mean"] + b["n"] * b["mean"]) / n).alias("mean"),
                            (a["m2"] + b["m2"] + F.pow(b["mean"] - a["mean"], F.lit(2.0)) * a["n"] * b["n"] / n).alias("m2"))
            return F.when(carried.isNull(), inside).when(b["n"] == 0, carried).otherwise(both)
        return (F.greatest if self.op == "max" else F.least)(carried, inside)


def hot_keys(df: DataFrame, keys: list[str], t: str, hot_rows: int) -> DataFrame | None:
    """Keys above ``hot_rows`` with the times at which they are cut, or None.

    At most count(df) / hot_rows rows.  Cuts are quantiles of the key's rows, so a burst is cut as finely as its rows demand;
    marks follow the largest key, two a chunk at least, so a chunk stays near ``hot_rows`` rows at every size.
    """
    return hot_keys_and_rows(df, keys, t, hot_rows)[0]


def hot_keys_and_rows(df: DataFrame, keys: list[str], t: str, hot_rows: int) -> tuple[DataFrame | None, int]:
    """``hot_keys`` and the number of all rows, from one counting pass."""
    every_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = F.col("_n") > hot_rows
    n, largest, rows = every_key.agg(F.count_if(over), F.max("_n"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if n == 0:
        return None, rows
    counts = every_key.filter(over)
    small = F.broadcast(counts) if n <= BROADCAST_KEYS else counts
    most = max(_LEAST_MARKS, 2 * math.ceil(largest / hot_rows))
    marks = [k / most for k in range(1, most)]
    span = (
        df.join(small.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(t, marks, 20 * most).alias("_q"))
    )
    chunks = F.ceil(F.col("_n") / F.lit(float(hot_rows))).cast("int")
    every = F.transform(F.sequence(F.lit(1), chunks - 1), lambda k: F.get("_q", (k * most / chunks).cast("int") - 1))
    out = span.select(*keys, F.array_distinct(F.when(chunks > 1, every).otherwise(F.array().cast("array<bigint>"))).alias("_cuts"))
    return F.broadcast(out) if n <= BROADCAST_KEYS else out, rows


def chunk_of(t: Column) -> Column:
    """Chunk number of a time under the cuts of ``hot_keys``; NULL for a cold key."""
    return F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < t))).cast("long")


def with_chunks(df: DataFrame, keys: list[str], t: str, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return df.withColumn(CHUNK, F.lit(None).cast("long"))
    return df.join(hot, keys, "left").withColumn(CHUNK, chunk_of(F.col(t))).drop("_cuts")


def running(df: DataFrame, keys: list[str], order: list[str], folds: list[Fold], chunked: bool, few: bool = False) -> DataFrame:
    """Add each fold over the rows of the same key strictly before this row.

    ``few``: there are so few chunks that their carries are broadcast and the rows stay where they are.
    """
    part = [*keys, CHUNK] if chunked else keys
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[f.over(w).alias(f.name) for f in folds])
    if not chunked:
        return out
    at = F.struct(*order)
    totals = (
        df.filter(F.col(CHUNK).isNotNull()).groupBy(*part).agg(*[f.total(at).alias(f.name) for f in folds])
    )
    wc = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    for f in folds:
        totals = f.prepare(totals, wc)
    carry = totals.select(*part, *[f.carry(wc).alias("_c_" + f.name) for f in folds])
    # NULL keys carry over like any other
    right = carry.select(*[F.col(c).alias("_k_" + c) for c in part], *[c for c in carry.columns if c not in part])
    same = F.col(CHUNK) == F.col("_k_" + CHUNK)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col("_k_" + c))
    joined = out.join(F.broadcast(right) if few else right, same, "left")
    names = {f.name for f in folds}
    return joined.select(
        *[c for c in out.columns if c not in names],
        *[f.join(F.col("_c_" + f.name), F.col(f.name)).alias(f.name) for f in folds],
    )


def score_cuts(df: DataFrame, col: str, buckets: int) -> list[float]:
    """At most ``buckets`` cut points of a numeric column, for ranking a table by it."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(col, probs, 1.0 / (4 * buckets))
    return sorted({float(x) for x in found})


def bucket_by_cuts(c: Column, cuts: list[float]) -> Column:
    if not cuts:
        return F.lit(0).cast("long")
    arr = F.array(*[F.lit(x) for x in cuts])
    return F.size(F.filter(arr, lambda x: x < c)).cast("long")


def global_running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums over the whole table in (bucket, order) order.

    One task never sees the whole table: rows are summed inside their bucket and only the
    bucket totals (as many rows as there are buckets) are folded in a single partition.
    """
    b = df.withColumn("_bucket", bucket)
    w = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = b.select("*", *[F.sum(v).over(w).alias(k) for k, v in sums.items()])
    totals = b.groupBy("_bucket").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    wb = Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_bucket", *[F.coalesce(F.sum(k).over(wb), F.lit(0)).alias("_c_" + k) for k in sums])
    out = inside.join(carry, "_bucket", "left")
    return out.select(*df.columns, *[(F.col(k) + F.col("_c_" + k)).alias(k) for k in sums])
