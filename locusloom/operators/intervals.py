"""Interval overlap joins by bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN = 512


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int = BIN) -> DataFrame:
    """Pairs with equal ``keys`` whose half-open (s, e) and (s2, e2) overlap. Each side is laid out over the bins it touches; a pair
    is kept only in the bin where its overlap begins, so it comes once."""
    spread = lambda df, s, e: df.where(f"{s} < {e}").withColumn("_bin", F.explode(F.expr(f"sequence({s} div {bin_size}, ({e} - 1) div {bin_size})")))
    met = spread(left, "s", "e").join(spread(right, "s2", "e2"), [*keys, "_bin"])
    return met.where(F.expr(f"s < e2 and e > s2 and _bin = greatest(s, s2) div {bin_size}")).drop("_bin")


def in_range(df: DataFrame, chrom: str, start: int | None, end: int | None, s: str = "s", e: str = "e") -> DataFrame:
    """Rows of one chromosome that overlap [start, end); an open side has no bound. The bounds reach the scan as filters."""
    out = df.where(F.col("chrom") == chrom)
    out = out if end is None else out.where(F.col(s) < end)
    return out if start is None else out.where(F.col(e) > start)
