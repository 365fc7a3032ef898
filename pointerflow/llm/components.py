"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: each node hands neighbours to its least neighbour.

    ``edges`` has a > b.  The large step hands on greater neighbours, the small
    step lesser ones and the node itself.
    """
    if small:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the least node of its component, for nodes with an edge.

    Alternates large and small star steps until the edges stay the same, in a
    number of rounds that grows with the logarithm of the longest path.  Every
    round is written to the shared folder.  Loops and repeated edges are
    harmless; null ends are dropped; no edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b")
    edges = saved(edges.distinct(), "components")
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        edges = saved(_stars(_stars(edges, small=False), small=True), "components")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
