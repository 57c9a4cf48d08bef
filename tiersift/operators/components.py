"""Connected components by alternating star steps; every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersift.runtime import join_per_key, materialize, release


def _stars(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = materialize(both.groupBy("a").agg(
        F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n")), "lowest")
    larger = join_per_key(both, lowest, "a", "b").filter(F.col("b") > F.col("a"))
    done = materialize(larger.select(F.col("low").alias("a"), "b").distinct(), "stars")
    release(lowest)
    return done


def _shortened(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of a node, and the node itself, to the smallest of them."""
    lowest = materialize(edges.groupBy("b").agg(F.min("a").alias("low"), F.count("*").alias("n")), "lowest")  # a < b
    others = join_per_key(edges, lowest, "b", "a").filter(F.col("a") > F.col("low")).select(
        F.col("low").alias("a"), F.col("a").alias("b"))
    done = materialize(others.unionByName(lowest.select(F.col("low").alias("a"), "b")).distinct(), "edges")
    release(lowest)
    return done


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge list ``a, b``, as a stored table; the root is the smallest node."""
    current = materialize(edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                           F.sum(F.xxhash64("b", "a", F.lit(1)).cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        stars = _stars(current)
        release(current)
        current = _shortened(stars)
        release(stars)
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    done = materialize(roots.unionByName(current.select(F.col("b").alias("node"), F.col("a").alias("root"))), "components")
    release(current)
    return done
