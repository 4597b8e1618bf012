"""Readers of alignment, annotation and log text. Lines are rows; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): numbers rise along each file; files in the order of their splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """chrom, chrom_len, ord, of the @SQ lines in their order."""
    rows = lines(spark, path).where("line like '@SQ%'")
    named = rows.select("line_no", F.regexp_extract("line", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("line", r"\tLN:(\d+)", 1).try_cast("long").alias("chrom_len"))
    return named.withColumn("ord", F.expr("row_number() over (order by line_no) - 1")).drop("line_no")


def sam_records(spark: SparkSession, path: str) -> DataFrame:
    """The eleven fixed fields, and the rest as one string of tags."""
    parts = lines(spark, path).where("line not like '@%' and line <> ''").select("line_no", F.split("line", "\t", 12).alias("f"))
    kinds = ["qname string", "flag int", "rname string", "pos bigint", "mapq int", "cigar string", "rnext string", "pnext bigint", "tlen bigint", "seq string", "qual string"]
    fields = [F.get("f", F.lit(k)).try_cast(x.split()[1]).alias(x.split()[0]) for k, x in enumerate(kinds)]
    return parts.select("line_no", *fields, F.coalesce(F.get("f", F.lit(11)), F.lit("")).alias("tags"))


def unknown_chromosomes(records: DataFrame, chroms: DataFrame) -> DataFrame:
    """Records on chromosomes that the header doesn't name."""
    return records.where("rname <> '*'").join(chroms.select(F.col("chrom").alias("rname")), "rname", "left_anti")


def reads_of(records: DataFrame) -> DataFrame:
    """Mapped records as reads: a record without a mate, or with an unmapped one, stands alone."""
    mapped = records.where((F.col("rname") != "*") & ~R.has(F.col("flag"), R.UNMAPPED))
    alone = (F.col("rnext") == "*") | R.has(F.col("flag"), R.MATE_UNMAPPED)
    mate = R.mate_chrom(F.col("rnext"), F.col("rname"))
    return mapped.select("line_no", "qname", F.col("rname").alias("chrom"), "pos", "cigar", F.when(~alone, mate).alias("mate_chrom"), F.when(~alone, F.col("pnext")).alias("mate_pos"), R.strand(F.col("tags")).alias("strand"), R.hits(F.col("tags")).alias("nh"))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """The fields of annotation lines; transcript_id and FPKM from the attributes, null where absent."""
    f = F.split("line", "\t")
    attribute = lambda name: F.nullif(F.regexp_extract("attributes", rf'{name} "([^"]+)"', 1), F.lit(""))
    rows = lines(spark, path).where("line not like '#%' and line <> ''").select("line_no", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(2)).alias("feature"), F.get(f, F.lit(3)).try_cast("long").alias("start"), F.get(f, F.lit(4)).try_cast("long").alias("end"), F.get(f, F.lit(6)).alias("strand"), F.coalesce(F.get(f, F.lit(8)), F.lit("")).alias("attributes"))
    return rows.withColumns({"transcript_id": attribute("transcript_id"), "fpkm": attribute("FPKM").try_cast("double")})


def gtf_exons(annotation: DataFrame, end: str = "inclusive") -> DataFrame:
    """transcript_id, chrom, exon, s, e, half-open; ``end`` 'exclusive' takes the last base for the bound."""
    from pyspark.sql import Window

    e = F.col("end") + 1 if end == "inclusive" else F.col("end")
    by = Window.partitionBy("transcript_id", "chrom").orderBy("start", "end")
    rows = annotation.where("feature = 'exon'").withColumn("exon", F.row_number().over(by) - 1)
    return rows.select("transcript_id", "chrom", "exon", F.col("start").alias("s"), e.alias("e"))


def gtf_quantities(annotation: DataFrame) -> DataFrame:
    return annotation.where("feature = 'transcript' and transcript_id is not null").select("transcript_id", F.coalesce("fpkm", F.lit(0.0)).alias("fpkm"))


def gene_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Distinct chrom, s, e, kind of simulated-expression profiles (``chrom:low-high`` and a strand in the first column)."""
    f = F.split("line", "\t")
    rows = lines(spark, path).where(F.size(f) >= 5).select(F.get(f, F.lit(0)).alias("locus"), F.get(f, F.lit(2)).alias("kind"))
    bound = lambda k: F.regexp_extract("locus", r":(\d+)-(\d+)", k).try_cast("long")
    return rows.select(F.split_part("locus", F.lit(":"), F.lit(1)).alias("chrom"), bound(1).alias("s"), bound(2).alias("e"), "kind").where("s is not null").distinct()


def peak_memory(spark: SparkSession, path: str) -> DataFrame:
    """The largest seventh column of a process log."""
    f = F.split(F.trim("line"), r"\s+")
    return lines(spark, path).select(F.get(f, F.lit(6)).try_cast("long").alias("m")).where("m is not null").agg(F.max("m").alias("peak"))
