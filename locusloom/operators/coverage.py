"""Coverage as difference arrays: segments of constant depth, never a row for each base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tiles import running


def steps(blocks: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, at, w): by how much the depth changes at a place, from rows with s, e and a weight."""
    edges = F.array(F.struct(F.col("s").alias("at"), F.expr(weight).alias("w")), F.struct(F.col("e").alias("at"), (-F.expr(weight)).alias("w")))
    return blocks.select(*keys, F.inline(edges)).groupBy(*keys, "at").agg(F.sum("w").alias("w"))


def segments(blocks: DataFrame, weight: str = "1.0D / nh", keys: list[str] = ("chrom",), hold=lambda df: df) -> DataFrame:
    """(chrom, s, e, v): maximal runs of one depth above 0, each read weighted by 1/NH. ``hold`` may write what is read twice."""
    keys = list(keys)
    depth = hold(running(hold(steps(blocks, keys, weight).where("w <> 0")), keys, "at", "w", "v"))
    return _closed(depth, keys)


def _closed(depth: DataFrame, keys: list[str]) -> DataFrame:
    """Segments from places of change: each lasts to the next place. The place after a tile's last comes from the tiles' firsts."""
    tile = F.expr("`at` div 65536")
    tiled = depth.withColumn("_tile", tile)
    firsts = tiled.groupBy(*keys, "_tile").agg(F.min("at").alias("_first"))
    after = firsts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_tile"))).drop("_first")
    within = tiled.withColumn("_own", F.lead("at").over(Window.partitionBy(*keys, "_tile").orderBy("at")))
    rows = within.join(after, [*keys, "_tile"]).select(*keys, F.col("at").alias("s"), F.coalesce("_own", "_next").alias("e"), "v")
    return rows.where("v > 1e-9 and e is not null")


def clipped(runs: DataFrame, start: int, end: int) -> DataFrame:
    return runs.where((F.col("s") < end) & (F.col("e") > start)).withColumn("s", F.greatest("s", F.lit(start))).withColumn("e", F.least("e", F.lit(end)))


def dense(runs: DataFrame, start: int, end: int, block: int = 1 << 16) -> DataFrame:
    """(s, cov): the depth at every place of [start, end), 0 where no segment is, in vectors of at most ``block`` places from s on.

    ``runs``: segments of one chromosome. A block's vector is its runs repeated and the gaps between them, so it costs its length."""
    first = lambda x: F.lit(start) + F.floor((x - F.lit(start)) / F.lit(block)) * F.lit(block)
    own = clipped(runs, start, end).withColumn("at", F.explode(F.sequence(first(F.col("s")), first(F.col("e") - 1), F.lit(block))))
    own = own.select("at", F.greatest("s", "at").alias("s"), F.least(F.col("e"), F.col("at") + block).alias("e"), F.col("v").cast("double").alias("v"))
    held = own.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("s", "e", "v"))).alias("x"))
    blocks = runs.sparkSession.range(start, max(start, end), block).select(F.col("id").alias("at"), F.least(F.col("id") + block, F.lit(end)).alias("to"))
    some = blocks.join(held, "at", "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<s:bigint,e:bigint,v:double>>")))
    before = lambda i: F.coalesce(F.get("x", i - 1)["e"], F.col("at"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    parts = F.transform("x", lambda r, i: F.concat(zeros(r["s"] - before(i)), F.array_repeat(r["v"], (r["e"] - r["s"]).cast("int"))))
    tail = zeros(F.col("to") - F.coalesce(F.try_element_at("x", F.lit(-1))["e"], F.col("at")))
    return some.select(F.col("at").alias("s"), F.concat(F.flatten(parts), tail).alias("cov"))
