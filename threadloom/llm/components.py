"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, save


def _least(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with the smallest of u and its v: u, v, m.  The minimum is combined before the shuffle.

    It is written first, so that the join is one of two tables and is split where a node has many neighbours.
    """
    least = save(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v), in either direction and repeated as they like, to node, component: the smallest node reached.

    Nodes without an edge to another node are left out.  Each round is written to the shared folder.
    """
    edges = save(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = _least(large)  # every u is larger than its v
        small = down.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        )
        last, edges = edges, save(small.distinct(), "edges")
        discard(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
