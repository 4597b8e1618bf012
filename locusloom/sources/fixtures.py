"""Alignments and annotation derived from the events and part tables by fixed integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fragments whose mates are farther apart than this don't hold a bundle open.
CUTOFF = 5000


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(
        "event_id",
        "concat('r', cast(event_id as string)) as qname",
        "event_type as chrom",
        "1 + user_id * 1000 + (event_id * 7919) % 600 as pos",
        "case when event_id % 50 = 1 then 20000L else 150 + cast(floor(value) as bigint) % 350 end as flen",
        "case event_id % 3 when 0 then '+' when 1 then '-' else cast(null as string) end as strand",
        "cast(1 + event_id % 2 as int) as nh",
        "case when event_id % 4 = 0 then '44M112N32M' when event_id % 7 = 0 then '5S71M' when event_id % 11 = 0 then '30M2D46M' else '76M' end as cigar",
        "event_id % 5 <> 0 as is_paired",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, qname, chrom, pos, cigar, mate_chrom, mate_pos, strand, nh: the first mate of every fragment, the second of pairs."""
    side = F.expr(
        """array(named_struct('line_no', 2 * event_id, 'pos', pos, 'cigar', cigar, 'mate_pos', case when is_paired then pos + flen - 76 end, 'keep', true),
                 named_struct('line_no', 2 * event_id + 1, 'pos', pos + flen - 76, 'cigar', '76M', 'mate_pos', pos, 'keep', is_paired))"""
    )
    rows = fragments(spark, sf_dir).select("qname", "chrom", "strand", "nh", "is_paired", F.inline(side)).where("keep")
    return rows.select("line_no", "qname", "chrom", "pos", "cigar", F.when(F.col("is_paired"), F.col("chrom")).alias("mate_chrom"), "mate_pos", "strand", "nh")


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript_id, chrom, exon, s, e: two exons for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    met = fragments(spark, sf_dir).join(part, F.col("event_id") == F.col("p_partkey") * 4)
    exons = F.expr("array(named_struct('exon', 0, 's', pos - 10, 'e', pos + 44), named_struct('exon', 1, 's', pos + 156, 'e', pos + 301))")
    return met.select(F.col("p_partkey").alias("transcript_id"), "chrom", F.inline(exons))


def chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, chrom_len, ord: names in order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.agg((F.max("user_id") + 1).alias("n"))
    names = events.groupBy(F.col("event_type").alias("chrom")).agg(F.count("*").alias("_"))
    rows = names.crossJoin(F.broadcast(users)).select("chrom", (F.col("n") * 1000 + 25000).alias("chrom_len"))
    return rows.withColumn("ord", F.expr("row_number() over (order by chrom) - 1"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads as raw records: flag, rname, rnext, pnext and tags as text has them, some unmapped or placed nowhere."""
    return reads(spark, sf_dir).selectExpr(
        "line_no",
        "qname",
        "cast(case when line_no % 13 = 0 then 4 else 0 end + case when line_no % 11 = 0 then 8 else 0 end + case when line_no % 2 = 0 then 64 else 128 end as int) as flag",
        "case when line_no % 17 = 0 then '*' else chrom end as rname",
        "case when line_no % 17 = 0 then 0L else pos end as pos",
        "50 as mapq",
        "cigar",
        "case when mate_pos is null then '*' else '=' end as rnext",
        "coalesce(mate_pos, 0L) as pnext",
        "0L as tlen",
        "concat_ws('\\t', concat('NH:i:', nh), concat('XS:A:', strand), case when mate_pos is null then 'YT:Z:UP' end) as tags",
    )


def other_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation moved a little, some second exons left out: a second set of transcripts to compare with."""
    rows = annotation(spark, sf_dir).where("not (exon = 1 and transcript_id % 7 = 0)")
    return rows.withColumn("s", F.expr("s + transcript_id % 5")).withColumn("e", F.expr("e - transcript_id % 3"))


def quantified(spark: SparkSession, sf_dir: str, other: int, factor: float) -> DataFrame:
    """A quantity for each part; those of keys that end in ``other`` have names of their own."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.when(F.col("p_partkey") % 10 == other, -F.col("p_partkey")).otherwise(F.col("p_partkey"))
    return part.select(name.alias("transcript_id"), (F.col("p_retailprice").cast("double") * factor).alias("fpkm"))
