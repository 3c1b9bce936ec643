"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v) with u > v. Large: each node's larger neighbours go to its least; small: its lesser ones.

    A node with very many neighbours is aggregated before the shuffle; the join back is one that Spark splits
    where it is skewed.
    """
    if large:
        near = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges in, (node, component) out: component is the least node that is reachable, for every node of an edge.

    Null ends and loops are dropped. Each round is written to the shared folder; rounds grow with the logarithm of
    the longest path. Nothing but a count and a checksum of each round reaches the driver.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    pairs, seen = materialize(pairs, "edges"), None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        pairs = materialize(_star(_star(pairs, True), False), "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
