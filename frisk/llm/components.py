"""Connected components by alternating large-star and small-star steps, each a pair of joins on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frisk.functions.keep import Scratch


def _smallest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, m): the smallest neighbour of each node, written so that the join behind it sees its size and can split hot nodes."""
    return scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")))


def _stars(edges: DataFrame) -> bool:
    """Whether every id of ``edges`` (u, v), u > v, is either on one edge as u or on edges as v alone."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id of each component, for every id that ``links`` (a, b) name.

    The result reads the last of the tables in ``scratch``.  Repeated and reversed links change nothing; a link of an id with itself is ignored.  Steps repeat until
    the edges are stars: every id has one edge up and none down, or none up.
    """
    edges = scratch.keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _smallest(both, scratch)
        large = scratch.keep(both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        root = _smallest(large, scratch)
        small = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
