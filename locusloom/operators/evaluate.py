"""Likeness of transcripts, and of two quantifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join


def exon_score(s1: Column, e1: Column, s2: Column, e2: Column, threshold: int) -> Column:
    if threshold == 0:
        return F.when((s1 == s2) & (e1 == e2), 1.0).otherwise(0.0)
    off = lambda x, y: F.least(F.abs(x - y), F.lit(threshold)) / F.lit(2.0 * threshold)
    return F.lit(1.0) - off(s1, s2) - off(e1, e2)


def spans(exons: DataFrame) -> DataFrame:
    return exons.groupBy("transcript_id", "chrom").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("len"))


def candidates(one: DataFrame, other: DataFrame) -> DataFrame:
    """Overlapping transcripts of both sets, with their numbers of exons and lengths."""
    a = spans(one).withColumnsRenamed({"transcript_id": "a", "n": "na", "len": "la"})
    b = spans(other).select(F.col("transcript_id").alias("b"), "chrom", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("n").alias("nb"), F.col("len").alias("lb"))
    return overlap_join(a, b, ["chrom"], 4096).select("chrom", "a", "b", "na", "nb", "la", "lb")


def _exon_pairs(one: DataFrame, other: DataFrame) -> DataFrame:
    pairs = candidates(one, other)
    a = one.select(F.col("transcript_id").alias("a"), "chrom", F.col("exon").alias("i"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = other.select(F.col("transcript_id").alias("b"), "chrom", F.col("exon").alias("j"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return pairs.join(a, ["chrom", "a"]).join(b, ["chrom", "b"])


def reciprocal_scores(one: DataFrame, other: DataFrame, threshold: int = 10) -> DataFrame:
    """(a, b, score): summed scores of exons that are each other's best match, over a's exons and b's others.

    An exon without any match above 0 points at the first exon, with score 0; ties go to the first.
    """
    scored = _exon_pairs(one, other).withColumn("x", exon_score(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"), threshold))
    best = lambda by, to: F.row_number().over(Window.partitionBy("chrom", "a", "b", by).orderBy(F.desc(F.greatest("x", F.lit(0.0))), to))
    ranked = scored.withColumns({"ri": best("i", "j"), "rj": best("j", "i")})
    sums = ranked.groupBy("chrom", "a", "b").agg(
        F.max("na").alias("na"), F.max("nb").alias("nb"),
        F.sum(F.when((F.col("ri") == 1) & (F.col("rj") == 1), F.greatest("x", F.lit(0.0))).otherwise(0.0)).alias("sum"),
        F.count_if((F.col("ri") == 1) & (F.col("rj") == 1)).alias("mutual"),
    )
    return sums.select("a", "b", (F.col("sum") / (F.col("na") + F.col("nb") - F.col("mutual"))).alias("score"))


def product_scores(one: DataFrame, other: DataFrame, threshold: int = 10) -> DataFrame:
    """(a, b, score): product of the scores of the exons in turn; 0 where their numbers differ."""
    scored = _exon_pairs(one, other).where("na <> nb or i = j").withColumn("x", exon_score(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"), threshold))
    xs = scored.groupBy("chrom", "a", "b").agg(F.max(F.col("na") == F.col("nb")).alias("same"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs"))
    return xs.select("a", "b", F.when(F.col("same"), F.aggregate("xs", F.lit(1.0), lambda p, v: p * v["x"])).otherwise(0.0).alias("score"))


def overlap_scores(one: DataFrame, other: DataFrame) -> DataFrame:
    """(a, b, score): squared overlap of the exons over the product of both lengths."""
    both = F.greatest(F.lit(0), F.least("e1", "e2") - F.greatest("s1", "s2"))
    sums = _exon_pairs(one, other).groupBy("chrom", "a", "b").agg(F.sum(both).alias("o"), F.max("la").alias("la"), F.max("lb").alias("lb"))
    return sums.select("a", "b", (F.col("o") * F.col("o") / (F.col("la") * F.col("lb"))).alias("score"))


def matched(one: DataFrame, other: DataFrame) -> DataFrame:
    """(transcript_id, x, y): both values, 0 where a side has none."""
    a, b = one.select("transcript_id", F.col("fpkm").alias("x")), other.select("transcript_id", F.col("fpkm").alias("y"))
    met = a.join(b, "transcript_id", "full_outer")
    return met.select("transcript_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def rmse(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), F.lit(2)))).alias("rmse"), F.corr("x", "y").alias("corr"))
