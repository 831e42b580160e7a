"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Kept


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of the links ``a, b``; the component is its smallest node.

    Large and small stars alternate until nothing changes: every node is linked to the smallest
    neighbour that is known, in rounds that grow with the logarithm of the longest path. A round is
    two sums by node with a join each, so a node with very many links meets partial sums and
    splittable joins only. Every round is written to the shared folder and the one before removed.
    Nulls and links of a node with itself are left out.
    """
    kept = Kept(links.sparkSession, "components")
    now = kept.write(_oriented(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    state = _state(now)
    while state[0]:
        after = kept.write(_small_star(_large_star(now)))
        kept.drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    """Number and check sum of the links."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
