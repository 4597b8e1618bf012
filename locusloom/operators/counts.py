"""Expression counts of annotated exons and junctions, from buckets' aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .buckets import ID, lifted_coverage
from .intervals import overlap_join


def exons(annotation: DataFrame) -> DataFrame:
    """Distinct (chrom, s, e)."""
    return annotation.select("chrom", "s", "e").distinct()


def junctions(annotation: DataFrame) -> DataFrame:
    """Distinct (chrom, s, e): from one exon's end to the next one's start, in the order of starts within a transcript."""
    by = Window.partitionBy("transcript_id", "chrom").orderBy("s", "e")
    rows = annotation.select("chrom", F.col("e").alias("s"), F.lead("s").over(by).alias("e"))
    return rows.where("e is not null").distinct()


def exon_counts(cover: DataFrame, els: DataFrame, lens: DataFrame, annotated: DataFrame) -> DataFrame:
    """(chrom, s, e, x): each bucket's summed coverage of an exon over its mean read length and NH; cross buckets by the same formula.

    A run of depth v is one row, however many reads it stands for. Equal runs of many buckets are added up before the join.
    """
    mean = lens.where("kind <> 'paired'").groupBy(*ID).agg((F.sum(F.col("len") * F.col("freq")) / F.sum("freq")).alias("mean"))
    runs = lifted_coverage(cover, els).join(mean, ID).select(F.col("chrom_e").alias("chrom"), "s", "e", (F.col("v") / (F.col("mean") * F.col("nh"))).alias("w"))
    runs = runs.groupBy("chrom", "s", "e").agg(F.sum("w").alias("w"))
    met = overlap_join(runs, annotated.select("chrom", F.col("s").alias("s2"), F.col("e").alias("e2")), ["chrom"])
    share = (F.least("e", "e2") - F.greatest("s", "s2")) * F.col("w")
    return met.groupBy("chrom", F.col("s2").alias("s"), F.col("e2").alias("e")).agg(F.sum(share).alias("x"))


def junction_counts(cover: DataFrame, els: DataFrame, annotated: DataFrame) -> DataFrame:
    """(chrom, s, e, x): by bucket and neighbouring path elements with an annotated gap, the lesser depth of its two flanks over NH."""
    by = Window.partitionBy(*ID).orderBy("k")
    lead = lambda c: F.lead(c).over(by)
    gaps = els.select(*ID, "nh", "k", "chrom_e", F.col("e").alias("d"), lead("s").alias("a"), lead("chrom_e").alias("chrom_a"), lead("off").alias("at"))
    gaps = gaps.where("a > d and chrom_a = chrom_e").join(annotated.select(F.col("chrom").alias("chrom_e"), F.col("s").alias("d"), F.col("e").alias("a")), ["chrom_e", "d", "a"])
    flanks = gaps.join(cover, ID).where("e >= at and s <= at")  # runs that hold the last place before the gap, or the first after it
    before, after = F.max(F.when((F.col("s") < F.col("at")) & (F.col("e") >= F.col("at")), F.col("v"))), F.max(F.when((F.col("s") <= F.col("at")) & (F.col("e") > F.col("at")), F.col("v")))
    each = flanks.groupBy(*ID, "k", "chrom_e", "d", "a", "nh").agg(F.least(F.coalesce(before, F.lit(0)), F.coalesce(after, F.lit(0))).alias("n"))
    return each.where("n > 0").groupBy(F.col("chrom_e").alias("chrom"), F.col("d").alias("s"), F.col("a").alias("e")).agg(F.sum(F.col("n") / F.col("nh")).alias("x"))
