"""Connected components of an edge table by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_hot


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the smallest node that can be reached.

    Loops and repeated edges do no harm; an empty table gives an empty result. Null ends are left out. The
    result reads its `tables`.
    """
    ab = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    stars, before = cut(ab.distinct(), "stars"), None
    while True:
        for large in (True, False):
            old, stars = stars, _star(stars, large)
            discard(old)
        mark = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if mark == before or not mark[0]:
            break
        before = mark
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    found.tables = [stars]
    return found


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the greater ones; small: the smaller ones and itself) to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times")), "star-least")
    linked = join_hot(both, least, ["a"], "times", "inner")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    found = cut(out.where("a > b").distinct(), "stars")
    discard(least)
    return found
