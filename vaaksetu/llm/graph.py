"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Returns (node, component): for each node with an edge, the smallest node it reaches.

    Edges stay in a distributed table throughout; each round is written to the shared folder, so a
    lost executor costs at most that round. Minima are combined before they are shuffled and the two
    joins are merge joins, which adaptive execution splits when one node has very many edges. Nothing is broadcast,
    as the size of a file of edges says little of the memory that its rows take on the driver.
    Self-loops, repeated edges and null ends are ignored; an empty table gives an empty result.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    e = stage(e, "edges")
    seen = _state(e)
    while seen[0]:
        # Large star: every larger neighbour of u points at the smallest neighbour of u.
        both = e.select(F.col("u").alias("x"), F.col("u").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m"))
        large = e.join(low.hint("merge"), e.u == low.x).select("v", F.col("m").alias("u")).where("v != u").distinct()
        # Small star: the smaller neighbours of v, and v itself, point at the smallest of them.
        low = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("x"), "m")
        inner = large.join(low.hint("merge"), large.v == low.x).where("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        nxt = stage(inner.union(low.select(F.col("x").alias("v"), F.col("m").alias("u"))).distinct(), "edges")
        now = _state(nxt)
        unstage(e)
        e = nxt
        if now == seen:
            break
        seen = now
    # At rest every node has one edge, to the root of its star; roots themselves have none.
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
