"""Connected components over an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, root): root is the smallest node that node reaches.

    Alternating large-star and small-star steps. A step takes each node's smallest neighbour by a pre-aggregated
    minimum and joins it back, so a node with very many neighbours is never gathered into one group. Self loops and
    repeated edges are allowed; an empty table gives no rows. Every round is written to the shared folder; rounds go on
    until one changes nothing.
    """
    e = staged(_ordered(edges.select("a", "b")), "cc")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _ordered(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(_ordered(moved.unionByName(least.select("a", F.col("m").alias("b")))), "cc")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, larger node first, without self loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
