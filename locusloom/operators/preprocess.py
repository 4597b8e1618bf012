"""Passes over raw records: filters, tag edits, fragment lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import records as R
from . import pairing


def mapped(records: DataFrame) -> DataFrame:
    return records.where((F.col("rname") != "*") & ~R.has(F.col("flag"), R.UNMAPPED))


def unsorted(records: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """Records whose place is before that of the line before them on their chromosome. Lines are looked at by tiles of line numbers;
    what stands before a tile is a row for each chromosome and tile."""
    tiled = records.withColumn("_tile", F.expr(f"line_no div {tile}"))
    lasts = tiled.groupBy("rname", "_tile").agg(F.max_by("pos", "line_no").alias("_last"))
    into = lasts.select("rname", "_tile", F.lag("_last").over(Window.partitionBy("rname").orderBy("_tile")).alias("_in"))
    own = tiled.withColumn("_own", F.lag("pos").over(Window.partitionBy("rname", "_tile").orderBy("line_no")))
    return own.join(into, ["rname", "_tile"]).where("pos < coalesce(_own, _in)").select(records.columns)


def in_order(records: DataFrame) -> DataFrame:
    """Records by chromosome, place and line, over partitions by range."""
    return records.repartitionByRange("rname", "pos").sortWithinPartitions("rname", "pos", "line_no")


def remove_unmapped(records: DataFrame) -> DataFrame:
    """Without records at no place, and without the tag of unpaired alignments."""
    return records.where("not (rname = '*' and pos = 0)").withColumn("tags", R.without_tag(F.col("tags"), "YT:Z:UP"))


def remove_pairing(records: DataFrame, just_flags: bool = False, only_unmapped_mates: bool = False) -> DataFrame:
    """FLAG 0 and, unless ``just_flags``, no mate; by choice only for records whose mate is unmapped."""
    which = R.has(F.col("flag"), R.MATE_UNMAPPED) if only_unmapped_mates else F.lit(True)
    edit = {"flag": F.lit(0)} if just_flags else {"flag": F.lit(0), "rnext": F.lit("*"), "pnext": F.lit(0).cast("long"), "tlen": F.lit(0).cast("long")}
    return records.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in edit.items()})


def of_length(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(C.reference_length(F.col("cigar")) == n)


def fragment_lengths(reads: DataFrame) -> DataFrame:
    """(len, freq): signed distance to the mate, over records with a mate on their chromosome."""
    rows = reads.where("mate_chrom = chrom")
    return rows.groupBy((F.col("mate_pos") - F.col("pos")).alias("len")).agg(F.count("*").alias("freq"))


def cutoff(reads: DataFrame, z: float = 0.125) -> DataFrame:
    """One row: mean of the lengths from 0 up over all records, deviation of all lengths about it over all records, and the cutoff."""
    n = reads.agg(F.count("*").alias("n"))
    lens = fragment_lengths(reads).agg(
        F.sum(F.when(F.col("len") >= 0, F.col("len") * F.col("freq")).otherwise(0)).alias("up"),
        F.sum("freq").alias("f"),
        F.sum(F.col("len") * F.col("freq")).alias("s1"),
        F.sum(F.col("len") * F.col("len") * F.col("freq")).alias("s2"),
    )
    mean = F.coalesce(F.col("up") / F.col("n"), F.lit(0.0))
    both = n.crossJoin(lens).select("n", mean.alias("mean"), ((F.col("s2") - 2 * mean * F.col("s1") + mean * mean * F.col("f")) / F.col("n")).alias("var"))
    sd = F.sqrt(F.coalesce(F.greatest("var", F.lit(0.0)), F.lit(0.0)))
    return both.select("n", "mean", sd.alias("sd"), F.floor(F.col("mean") + F.lit(z) * sd).cast("long").alias("cutoff"))


def long_share(reads: DataFrame, limit: int) -> DataFrame:
    """Percent of all records whose mate is farther ahead than ``limit``."""
    far = F.coalesce((F.col("mate_chrom") == F.col("chrom")) & (F.col("mate_pos") - F.col("pos") > limit), F.lit(False))
    return reads.agg((F.avg(F.when(far, 1.0).otherwise(0.0)) * 100).alias("percent"))


def tophat(records: DataFrame) -> DataFrame:
    """The steps for one spliced aligner's output: strands from mates, then sorted."""
    return in_order(pairing.infer_record_strand(records))


def hisat(records: DataFrame, hold=lambda df: df) -> DataFrame:
    """The steps for the other's: no unmapped records, mates enumerated all against all, strands from mates, then sorted."""
    return in_order(pairing.infer_record_strand(pairing.enumerated_records(remove_unmapped(records), hold)))
