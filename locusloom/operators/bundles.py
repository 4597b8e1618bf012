"""Bundles (gap-and-islands over read extents), breakpoints and subexons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.tiles import running
from .intervals import overlap_join

RADIUS = 50


def parsed(reads: DataFrame, legacy: bool = False) -> DataFrame:
    """``reads`` with ``blocks``, null for a record without a CIGAR."""
    return reads.withColumn("blocks", C.blocks(F.col("cigar"), F.col("pos"), legacy))


def filled(rows: DataFrame) -> DataFrame:
    """Parsed rows that have blocks. A record without takes those of its mate, where both are at the same place."""
    own = rows.where("blocks is not null and size(blocks) > 0")
    lack = rows.where("blocks is null and mate_pos = pos and mate_chrom = chrom")
    mates = own.where("mate_pos = pos and mate_chrom = chrom").groupBy("qname", "chrom", "pos").agg(F.min_by("blocks", "line_no").alias("_mate"))
    return own.union(lack.join(mates, ["qname", "chrom", "pos"]).withColumn("blocks", F.col("_mate")).select(rows.columns))


def with_blocks(reads: DataFrame, legacy: bool = False) -> DataFrame:
    """``reads`` that have blocks of their own, with them."""
    return parsed(reads, legacy).where("blocks is not null and size(blocks) > 0")


def extents(rows: DataFrame, cutoff: int | None) -> DataFrame:
    """``rows`` (with blocks) with s and e: what each read holds open. A mate expected less than ``cutoff`` ahead counts up to its start."""
    s, e = F.get("blocks", F.lit(0))["s"], F.element_at("blocks", -1)["e"]
    ahead = F.when((F.col("mate_chrom") == F.col("chrom")) & (F.col("mate_pos") > F.col("pos")) & (F.col("mate_pos") - F.col("pos") < F.lit(cutoff)), F.col("mate_pos"))
    return rows.withColumn("s", s).withColumn("e", F.greatest(e, ahead) if cutoff is not None else e)


def islands(spans: DataFrame, radius: int = RADIUS, hold=lambda df: df) -> DataFrame:
    """(chrom, s, e) -> (chrom, s, bundle_id): a new bundle starts where s is more than ``radius`` past all earlier ends.

    Spans with one start are one row first, so a tile's window has a row for each base at most. ``hold`` may
    write what is read twice.
    """
    starts = hold(spans.groupBy("chrom", "s").agg(F.max("e").alias("e")))
    flagged = running(starts, ["chrom"], "s", "e", "_reach", how="max", inclusive=False)
    flagged = flagged.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("s") > F.col("_reach") + radius), 1).otherwise(0))
    return running(flagged, ["chrom"], "s", "_new", "bundle_id").select("chrom", "s", "e", "bundle_id")


def bundles(starts: DataFrame) -> DataFrame:
    """(chrom, bundle_id, s, e) from ``islands``."""
    return starts.groupBy("chrom", "bundle_id").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def assigned(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` (with s) with their bundle_id."""
    return rows.join(starts.select("chrom", "s", "bundle_id"), ["chrom", "s"])


def breakpoints(rows: DataFrame, whole: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Distinct (chrom, bundle_id, bp): bundle bounds, the ends of introns in ``rows`` (with blocks and bundle_id), and of the
    annotation's ``points`` (chrom, p) those past a bundle's start and up to its end."""
    ends = whole.select("chrom", "bundle_id", F.explode(F.array("s", "e")).alias("bp"))
    gaps = rows.where("size(blocks) > 1").select("chrom", "bundle_id", F.explode(C.introns(F.col("blocks"))).alias("i")).select("chrom", "bundle_id", F.explode(F.array("i.s", "i.e")).alias("bp"))
    out = ends.union(gaps)
    if points is not None:
        spots = points.distinct().select("chrom", F.col("p").alias("s2"), (F.col("p") + 1).alias("e2"), "p")
        spans = whole.select("chrom", "bundle_id", (F.col("s") + 1).alias("s"), (F.col("e") + 1).alias("e"))
        out = out.union(overlap_join(spans, spots, ["chrom"], 4096).select("chrom", "bundle_id", "p"))
    return out.distinct()


def subexons(points: DataFrame) -> DataFrame:
    """(chrom, bundle_id, subexon_id, s, e): the intervals between neighbouring breakpoints of a bundle, numbered from 0."""
    by = Window.partitionBy("chrom", "bundle_id").orderBy("bp")
    rows = points.select("chrom", "bundle_id", (F.row_number().over(by) - 1).alias("subexon_id"), F.col("bp").alias("s"), F.lead("bp").over(by).alias("e"))
    return rows.where("e is not null")


def prefix(parts: DataFrame) -> DataFrame:
    """``subexons`` with the summed length of those before each in its bundle."""
    by = Window.partitionBy("chrom", "bundle_id").orderBy("subexon_id").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum(F.col("e") - F.col("s")).over(by), F.lit(0)))


def stats(whole: DataFrame) -> DataFrame:
    n = F.col("e") - F.col("s")
    return whole.agg(F.count("*").alias("bundles"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean_length"))
