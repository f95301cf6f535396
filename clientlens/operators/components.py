"""Connected components of a link table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _mark(links: DataFrame) -> tuple:
    """Tells one link table from another."""
    hashed = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(hashed), F.sum(hashed % 1_000_000_007)).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``node, component``, the smallest node reachable, for
    every node of a link (a link of a node with itself names the node alone).

    Each round hangs a node's neighbours on the smallest of them; rounds grow
    with the logarithm of the largest component. A minimum and a join do it, so
    no task gathers the neighbours of a node. Every round is a small table in
    the shared checkpoint folder."""
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        # large star: every larger neighbour of a node hangs on its smallest
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(least.where("low < a").select("a", F.col("low").alias("b"))).distinct())
        # small star: every smaller neighbour and the node itself hang on the smallest
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        links = written(large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                        .union(low.select("a", F.col("low").alias("b"))).distinct())
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return written(links.select(F.col("a").alias("node"), F.col("b").alias("component"))
                   .union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).union(alone).distinct())
