"""Bundles over a stream of reads: a session on the position, which plays the part of time.

A read holds its session open to its end and the radius past it; a bundle comes out once the watermark has passed it. Reads may come
up to ``late`` bases out of order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bundles import RADIUS


def bundle_stream(spans: DataFrame, late: int = 0, radius: int = RADIUS) -> DataFrame:
    """(chrom, s, e) as a stream -> (chrom, s, e, n) of closed bundles. A start ``radius`` past the end still belongs."""
    timed = spans.withColumn("at", F.timestamp_seconds("s")).withWatermark("at", f"{late} seconds")
    gap = F.concat((F.col("e") - F.col("s") + radius + 1).cast("string"), F.lit(" seconds"))
    closed = timed.groupBy("chrom", F.session_window("at", gap)).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))
    return closed.select("chrom", "s", "e", "n")
