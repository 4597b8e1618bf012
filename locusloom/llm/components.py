"""Connected components by alternating large-star and small-star steps, in DataFrame operations on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

#: Edges for each part over which a vertex's edges are dealt: few edges, one part.
DEAL = 1_000_000


def _least(both: DataFrame, parts: int) -> DataFrame:
    """(a, b) with m, the smallest of a and its neighbours. The edges of one vertex are dealt over ``parts`` parts: each part's smallest
    comes first, so a vertex with many edges is never one task's."""
    least = F.least(F.min("b"), F.first("a")).alias("m")
    if parts == 1:
        return both.join(both.groupBy("a").agg(least), "a")
    dealt = both.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)))
    own = dealt.groupBy("a", "part").agg(least)
    whole = own.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(own.select("a", "part").join(whole, "a"), ["a", "part"]).drop("part")


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _least(both, parts)
    if large:
        return near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.where("a <> m").select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(vid, root) for every vertex that has an edge; root is the smallest vertex of its component. ``edges``: a, b."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state, parts = None, now.count() // DEAL + 1
    for _ in range(most):
        before = now
        now = staged(_star(_star(now, True, parts).where("a <> b").distinct(), False, parts).where("a <> b").distinct(), "edges")
        dropped(before)
        then, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if then == state:
            break
    else:
        raise RuntimeError("components did not settle")
    rooted = now.select(F.col("a").alias("vid"), F.col("b").alias("root")).union(now.select(F.col("b").alias("vid"), F.col("b").alias("root")).distinct())
    found = staged(rooted, "roots")
    dropped(now)
    return found
