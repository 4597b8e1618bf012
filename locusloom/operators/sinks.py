"""Text sinks: alignment lines, tab-separated ranges and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C


def placed_fragments(frags: DataFrame, rows: DataFrame) -> DataFrame:
    """(frag, strand, nh, ca, ba, cb, bb): fragments with chromosome and blocks of both records; cb and bb null if unpaired."""
    reads = rows.select("line_no", "chrom", "blocks")
    return frags.select("frag", "line_a", "line_b", "strand", "nh").join(reads.toDF("line_a", "ca", "ba"), "line_a").join(reads.toDF("line_b", "cb", "bb"), "line_b", "left").drop("line_a", "line_b")


def sam_lines(placed: DataFrame, force_strand: bool = False) -> DataFrame:
    """(frag, side, line): a line for each record of each fragment; fragments with blocks that go backwards are left out.

    Unpaired: FLAG 0. Pairs: 81 and 161, the distance from a's start to the later end as TLEN, negated on b, 0 across chromosomes.
    ``force_strand`` gives spliced fragments without a strand one by their number.
    """
    both = placed.where(C.valid(F.col("ba")) & F.coalesce(C.valid(F.col("bb")), F.lit(True)))
    if force_strand:
        spliced = (F.size("ba") > 1) | F.coalesce(F.size("bb") > 1, F.lit(False))
        both = both.withColumn("strand", F.coalesce("strand", F.when(spliced, F.when(F.col("frag") % 2 == 0, "+").otherwise("-"))))
    start = lambda x: F.get(x, F.lit(0))["s"]
    end = lambda x: F.element_at(x, -1)["e"]
    both = both.withColumn("cigar_a", C.to_cigar(F.col("ba"))).withColumn("cigar_b", C.to_cigar(F.col("bb")))
    paired, same = F.col("bb").isNotNull(), F.col("ca") == F.col("cb")
    span = F.when(same, F.greatest(end("ba"), end("bb")) - start("ba")).otherwise(0)
    tags = F.concat_ws("\t", F.concat(F.lit("NH:i:"), F.col("nh")), F.concat(F.lit("XS:A:"), F.col("strand")))

    def line(flag, chrom, own, cigar, mate_chrom, mate, tlen):
        rnext = F.when(~paired, "*").when(same, "=").otherwise(F.col(mate_chrom))
        return F.concat_ws("\t", F.concat("ca", F.lit(":"), "frag"), flag.cast("string"), F.col(chrom), start(own).cast("string"), F.lit("50"), F.col(cigar), rnext, F.when(paired, start(mate)).otherwise(0).cast("string"), F.when(paired, tlen).otherwise(0).cast("string"), F.lit("*"), F.lit("*"), tags)

    first = F.struct(F.lit("a").alias("side"), line(F.when(paired, 81).otherwise(0), "ca", "ba", "cigar_a", "cb", "bb", span).alias("line"))
    second = F.struct(F.lit("b").alias("side"), line(F.lit(161), "cb", "bb", "cigar_b", "ca", "ba", -span).alias("line"))
    return both.select("frag", F.inline(F.when(paired, F.array(first, second)).otherwise(F.array(first))))


def header_lines(chroms: DataFrame) -> DataFrame:
    head = chroms.select((F.col("ord") + 1).alias("ord"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "chrom"), F.concat(F.lit("LN:"), "chrom_len")).alias("line"))
    one = chroms.sparkSession.range(1).select(F.lit(0).cast("long").alias("ord"), F.lit("@HD\tVN:1.0\tSO:unsorted").alias("line"))
    return one.union(head.select(F.col("ord").cast("long"), "line"))


def write_sam(placed: DataFrame, chroms: DataFrame | None, path: str, force_strand: bool = False) -> None:
    """A folder of text: the header, if any, in a part of its own that sorts first."""
    body = sam_lines(placed, force_strand).select("line")
    if chroms is not None:
        header_lines(chroms).coalesce(1).sortWithinPartitions("ord").select("line").write.mode("overwrite").text(f"{path}/0-header")
    body.write.mode("overwrite").text(f"{path}/1-alignments")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_counts(exons: DataFrame, juncs: DataFrame, path: str) -> None:
    write_table(exons.select("chrom", "s", "e", "x"), f"{path}.exons.txt")
    write_table(juncs.select("chrom", "s", "e", "x"), f"{path}.juncs.txt")


def vector_text(cov: str = "cov"):
    return F.array_join(F.transform(cov, lambda x: x.cast("string")), ",")
