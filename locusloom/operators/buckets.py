"""Subexon paths of reads and fragments, and the buckets of those that share one.

A bucket is named by ``ID``: its chromosome, its bundle, and within that a hash of its path, strand and NH. Pairs between bundles have
buckets of their own, named by the bundle of their first record; their path is the first record's, then the second's. A bucket has a
coordinate of its own: its path's subexons laid side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from . import pairing
from .intervals import overlap_join

ID = ["chrom", "bundle_id", "bucket"]


def incidences(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(line_no, chrom, bundle_id, subexon_id, s, e, sub_s, sub_e): what each record's blocks cover of each subexon."""
    own = rows.select("line_no", "chrom", "bundle_id", F.inline("blocks"))
    other = parts.select("chrom", "bundle_id", "subexon_id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    met = overlap_join(own, other, ["chrom", "bundle_id"])
    return met.select("line_no", "chrom", "bundle_id", "subexon_id", F.greatest("s", "s2").alias("s"), F.least("e", "e2").alias("e"), F.col("s2").alias("sub_s"), F.col("e2").alias("sub_e"))


def read_paths(met: DataFrame) -> DataFrame:
    """(line_no, chrom, bundle_id, path): sorted subexon ids that a record touches."""
    return met.groupBy("line_no", "chrom", "bundle_id").agg(F.sort_array(F.collect_set("subexon_id")).alias("path"))


def fragments(rows: DataFrame, paths: DataFrame, pairs: DataFrame, split_discordant: bool = False) -> DataFrame:
    """One row for each pair, and each record that has no mate.

    frag (line of a), line_a, line_b (null if unpaired), chrom, bundle_id, chrom_b, bundle_id_b, path_a, path_b, path, code, strand, nh,
    cross, bucket. The path of a pair that agrees: a's ids below b's first, then b's; of one that doesn't, and of pairs between bundles
    (``cross``): a's then b's. ``split_discordant`` treats pairs that disagree as two unpaired records.
    """
    placed = rows.join(paths.select("line_no", "path"), "line_no")
    two = pairing.discordance(pairing.oriented(pairs, placed, ["bundle_id", "path"]))
    if split_discordant:
        two = two.where("code = 0")
    strand, nh = F.coalesce("strand_a", "strand_b"), F.least("nh_a", "nh_b")
    cross = (F.col("chrom_a") != F.col("chrom_b")) | (F.col("bundle_id_a") != F.col("bundle_id_b"))
    agreed = F.concat(F.filter("path_a", lambda x: x < F.get(F.col("path_b"), F.lit(0))), F.col("path_b"))
    path = F.when(~cross & (F.col("code") == 0), agreed).otherwise(F.concat("path_a", "path_b"))
    both = two.select(
        F.col("line_a").alias("frag"), "line_a", "line_b", F.col("chrom_a").alias("chrom"), F.col("bundle_id_a").alias("bundle_id"), "chrom_b", "bundle_id_b",
        "path_a", "path_b", path.alias("path"), "code", strand.alias("strand"), nh.alias("nh"), cross.alias("cross"),
    )
    used = two.select(F.explode(F.array("line_a", "line_b")).alias("line_no"))
    one = placed.join(used, "line_no", "left_anti").select(
        F.col("line_no").alias("frag"), F.col("line_no").alias("line_a"), F.lit(None).cast("long").alias("line_b"), "chrom", "bundle_id", F.col("chrom").alias("chrom_b"), F.col("bundle_id").alias("bundle_id_b"),
        F.col("path").alias("path_a"), F.lit(None).cast("array<int>").alias("path_b"), "path", F.lit(0).alias("code"), "strand", "nh", F.lit(False).alias("cross"),
    )
    other = lambda c: F.when(F.col("cross"), F.col(c))
    return both.unionByName(one).withColumn("bucket", F.xxhash64("path", other("chrom_b"), other("bundle_id_b"), F.when(F.col("cross"), F.size("path_a")), "strand", "nh"))


def buckets(frags: DataFrame) -> DataFrame:
    """A row for each bucket: ID, path, cross, chrom_b and bundle_id_b and path_a and path_b (of cross buckets), strand, nh, and the numbers
    of unpaired and paired fragments."""
    own = [F.first(c).alias(c) for c in ("path", "cross", "strand", "nh")]
    other = [F.first(F.when(F.col("cross"), F.col(c))).alias(c) for c in ("chrom_b", "bundle_id_b", "path_a", "path_b")]
    return frags.groupBy(*ID).agg(*own, *other, F.count_if(F.col("line_b").isNull()).alias("n_unpaired"), F.count_if(F.col("line_b").isNotNull()).alias("n_paired"))


def label() -> Column:
    """A bucket's path as text: subexon ids; of cross buckets the first record's, the other bundle, and the second record's."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return F.when(F.col("cross"), F.concat_ws("/", text("path_a"), F.col("bundle_id_b").cast("string"), text("path_b"))).otherwise(text("path"))


def elements(held: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each subexon of each bucket's path: ID, nh, k, subexon_id, chrom_e, bundle_e, s, e, and off, where it begins in the
    bucket's coordinate, whose length is ``total``."""
    spots = held.select(*ID, "nh", "cross", "chrom_b", "bundle_id_b", F.size("path_a").alias("na"), F.posexplode("path").alias("k", "subexon_id"))
    second = F.col("cross") & (F.col("k") >= F.col("na"))
    spots = spots.select(*ID, "nh", "k", "subexon_id", F.when(second, F.col("chrom_b")).otherwise(F.col("chrom")).alias("chrom_e"), F.when(second, F.col("bundle_id_b")).otherwise(F.col("bundle_id")).alias("bundle_e"))
    placed = spots.join(parts.withColumnsRenamed({"chrom": "chrom_e", "bundle_id": "bundle_e"}), ["chrom_e", "bundle_e", "subexon_id"])
    by = Window.partitionBy(*ID)
    before = by.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("e") - F.col("s")
    return placed.select(*ID, "nh", "k", "subexon_id", "chrom_e", "bundle_e", "s", "e", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("off"), F.sum(n).over(by).alias("total"))


def lengths(frags: DataFrame, rows: DataFrame, els: DataFrame) -> DataFrame:
    """(ID, kind, len, freq): read lengths of unpaired records, of left and right mates, and fragment lengths without introns."""
    reads = rows.select("line_no", C.read_length(F.col("blocks")).alias("len"), F.get("blocks", F.lit(0))["s"].alias("first"), F.element_at("blocks", -1)["e"].alias("last"))
    whole = frags.select(*ID, "line_a", "line_b").join(reads.toDF("line_a", "len_a", "first", "last_a"), "line_a").join(reads.toDF("line_b", "len_b", "first_b", "last"), "line_b", "left")
    ends = els.groupBy(*ID).agg(F.min_by("s", "k").alias("low"), F.max_by("e", "k").alias("high"), F.max("total").alias("total"))
    span = F.col("total") - (F.col("first") - F.col("low")) - (F.col("high") - F.col("last"))
    kind = lambda name, n: F.struct(F.lit(name).alias("kind"), n.cast("long").alias("len"))
    single, two = F.array(kind("unpaired", F.col("len_a"))), F.array(kind("left", F.col("len_a")), kind("right", F.col("len_b")), kind("paired", span))
    return whole.join(ends, ID).select(*ID, F.inline(F.when(F.col("line_b").isNull(), single).otherwise(two))).groupBy(*ID, "kind", "len").agg(F.count("*").alias("freq"))


def local_blocks(frags: DataFrame, met: DataFrame, els: DataFrame) -> DataFrame:
    """(ID, s, e): what records cover of their buckets' path elements, in bucket places. Of pairs that disagree, and pairs between
    bundles, each record covers its own part of the path only."""
    na, apart = F.size("path_a"), F.col("line_b").isNotNull() & (F.col("cross") | (F.col("code") != 0))
    side = lambda line, low, high: F.struct(F.col(line).alias("line_no"), low.alias("low"), high.alias("high"))
    most = F.lit((1 << 31) - 1)
    lines = frags.select(*ID, F.inline(F.array(side("line_a", F.lit(0), F.when(apart, na).otherwise(most)), side("line_b", F.when(apart, na).otherwise(0), most)))).where("line_no is not null")
    covers = met.select("line_no", F.col("chrom").alias("chrom_e"), F.col("bundle_id").alias("bundle_e"), "subexon_id", "s", "e", "sub_s")
    spots = els.select(*ID, "k", "subexon_id", "chrom_e", "bundle_e", "off")
    both = lines.join(covers, "line_no").join(spots, [*ID, "subexon_id", "chrom_e", "bundle_e"]).where("k >= low and k < high")
    return both.select(*ID, (F.col("off") + F.col("s") - F.col("sub_s")).alias("s"), (F.col("off") + F.col("e") - F.col("sub_s")).alias("e"))


def bucket_coverage(local: DataFrame) -> DataFrame:
    """(ID, s, e, v): depth above 0 in bucket places."""
    edges = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("w")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("w")))
    step = local.select(*ID, F.inline(edges)).groupBy(*ID, "at").agg(F.sum("w").alias("w")).where("w <> 0")
    by = Window.partitionBy(*ID).orderBy("at")
    runs = step.select(*ID, F.col("at").alias("s"), F.lead("at").over(by).alias("e"), F.sum("w").over(by).alias("v"))
    return runs.where("e is not null and v > 0")


def lifted_coverage(cover: DataFrame, els: DataFrame) -> DataFrame:
    """(ID, nh, chrom_e, s, e, v): the runs of ``bucket_coverage`` in genomic places, cut at subexon bounds."""
    spots = els.select(*ID, "nh", "chrom_e", F.col("s").alias("sub_s"), F.col("e").alias("sub_e"), "off")
    met = cover.join(spots, ID).where("s < off + sub_e - sub_s and e > off")
    low, high = F.greatest("s", "off") - F.col("off"), F.least(F.col("e") - F.col("off"), F.col("sub_e") - F.col("sub_s"))
    return met.select(*ID, "nh", "chrom_e", (F.col("sub_s") + low).alias("s"), (F.col("sub_s") + high).alias("e"), "v")


def relevant(els: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """IDs of the buckets with a path element in the range, those of pairs between bundles by either of their bundles."""
    return els.where((F.col("chrom_e") == chrom) & (F.col("s") < end) & (F.col("e") > start)).select(*ID).distinct()


def longest_reads(rows: DataFrame) -> DataFrame:
    """(chrom, bundle_id, longest): the length of each bundle's longest record."""
    return rows.groupBy("chrom", "bundle_id").agg(F.max(C.read_length(F.col("blocks"))).alias("longest"))


def collapsed(rows: DataFrame) -> DataFrame:
    """(chrom, bundle_id, s, e, n): how many records lie from s to e."""
    return rows.groupBy("chrom", "bundle_id", F.get("blocks", F.lit(0))["s"].alias("s"), F.element_at("blocks", -1)["e"].alias("e")).agg(F.count("*").alias("n"))
