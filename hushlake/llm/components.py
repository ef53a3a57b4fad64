"""Connected components of a graph of edges, by alternating large and small stars.

Each round sends every node's larger neighbours, then its smaller ones, to the least node around it; the
number of rounds grows with the logarithm of a component's size. Minima are aggregated before
the shuffle, and each round's edges are a written table. Nothing is gathered in one place but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, written


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) the table (node, component) of the nodes that have any; a component is its least node."""
    now = _written(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y"))
    seen = _checksum(now)
    while True:
        both = now.select("x", "y").unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        small_least = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(small_least, "x").where(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        before, now = now, _written(moved.unionByName(small_least.select("x", F.col("m").alias("y"))))
        release(before)
        if (sums := _checksum(now)) == seen:
            break
        seen = sums
    nodes = now.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return nodes.unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())


def _written(edges: DataFrame) -> DataFrame:
    return written(edges.distinct(), "edges")


def _checksum(edges: DataFrame) -> tuple:
    half = F.xxhash64("x", "y").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(half)).first())
