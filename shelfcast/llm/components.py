"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import store_table


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (bigint columns a, b); root is the smallest node reachable.

    A large-star step links every larger neighbour of a node to the node's smallest neighbour, a
    small-star step does so with the smaller ones; a logarithmic number of rounds leaves stars. Minima are
    combined before the shuffle, the joins have one row per node on one side, so adaptive execution can
    split a hub, and each round is stored. Loops, repeated and reversed edges do no harm. No edges give
    no rows.
    """
    current = store_table(_larger_first(edges.select("a", "b")), "edges")
    seen = _checksum(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        smallest = F.least(F.col("a"), F.col("least"))
        large = _larger_first(current.select(F.col("b").alias("a"), F.col("a").alias("far")).join(least, "a")
                              .select(F.col("far").alias("a"), smallest.alias("b")))
        large = store_table(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(least.select("a", F.col("least").alias("b"))))
        current = store_table(_larger_first(small), "small-star")
        now = _checksum(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _larger_first(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])
