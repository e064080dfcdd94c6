"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def components(edges: DataFrame) -> DataFrame:
    """node and the least node it is connected with, for every linked node but those least ones; edges: two columns of integers.

    Loops, repeated edges and nulls are ignored; an empty table gives an empty one.
    """
    a, b = edges.columns
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = cut(edges)
    seen, mark = None, _mark(edges)
    while mark != seen:
        after = cut(_small_star(_large_star(edges)))
        drop_cut(edges)
        edges, seen, mark = after, mark, _mark(after)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
