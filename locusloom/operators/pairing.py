"""Mates: one-to-one matching, strand conflicts, discordance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import records as R

KEY = ["qname", "chrom", "pos", "mate_chrom", "mate_pos"]


def mate_pairs(reads: DataFrame) -> DataFrame:
    """(line_a, line_b): records whose places mirror each other, matched in order of line.

    Equal keys are numbered on both sides and the k-th meets the k-th; mates at one place share a key, so there the odd meet the even.
    """
    by = Window.partitionBy(*KEY).orderBy("line_no")
    rows = reads.where("mate_pos is not null and mate_chrom is not null").select("line_no", *KEY).withColumn("rn", F.row_number().over(by))
    apart = rows.where("not (chrom = mate_chrom and pos = mate_pos)")
    first = apart.where("struct(chrom, pos) < struct(mate_chrom, mate_pos)").select(F.col("line_no").alias("line_a"), *KEY, "rn")
    second = apart.where("struct(chrom, pos) > struct(mate_chrom, mate_pos)").select(F.col("line_no").alias("line_b"), "qname", F.col("mate_chrom").alias("chrom"), F.col("mate_pos").alias("pos"), F.col("chrom").alias("mate_chrom"), F.col("pos").alias("mate_pos"), "rn")
    same = rows.where("chrom = mate_chrom and pos = mate_pos").withColumn("k", F.expr("(rn - 1) div 2"))
    twos = same.groupBy(*KEY, "k").agg(F.min("line_no").alias("line_a"), F.max("line_no").alias("line_b"), F.count("*").alias("n")).where("n = 2")
    return first.join(second, [*KEY, "rn"]).select("line_a", "line_b").union(twos.select("line_a", "line_b"))


def sided(reads: DataFrame, columns: list[str], side: str) -> DataFrame:
    return reads.select(F.col("line_no").alias(f"line_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def joined(pairs: DataFrame, reads: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the columns of both records."""
    return pairs.join(sided(reads, columns, "a"), "line_a").join(sided(reads, columns, "b"), "line_b")


def unmatched(reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records that expect a mate and have none."""
    lines = pairs.select(F.explode(F.array("line_a", "line_b")).alias("line_no"))
    return reads.where("mate_pos is not null").join(lines, "line_no", "left_anti")


def different_strands(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    """Pairs whose records name opposite strands."""
    return joined(pairs, reads, ["strand"]).where("strand_a <> strand_b").select("line_a", "line_b", "strand_a", "strand_b")


def oriented(pairs: DataFrame, rows: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Pairs with both records' columns; b is the one that ends later (then starts later, then comes later)."""
    columns = ["chrom", "blocks", "strand", "nh", *extra]
    met = joined(pairs, rows, columns)
    rank = lambda x: F.struct(F.element_at(f"blocks_{x}", -1)["e"], F.get(f"blocks_{x}", F.lit(0))["s"], F.col(f"line_{x}"))
    turn = rank("a") > rank("b")
    names = ["line", *columns]
    return met.select(*(F.when(turn, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a") for c in names), *(F.when(turn, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b") for c in names))


def placed_fragments(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(frag, strand, nh, ca, ba, cb, bb): pairs, and records of no pair, with chromosomes and blocks; cb and bb null if unpaired."""
    two = oriented(pairs, rows)
    both = two.select(F.col("line_a").alias("frag"), F.coalesce("strand_a", "strand_b").alias("strand"), F.least("nh_a", "nh_b").alias("nh"), F.col("chrom_a").alias("ca"), F.col("blocks_a").alias("ba"), F.col("chrom_b").alias("cb"), F.col("blocks_b").alias("bb"))
    used = pairs.select(F.explode(F.array("line_a", "line_b")).alias("line_no"))
    one = rows.join(used, "line_no", "left_anti").select(F.col("line_no").alias("frag"), "strand", "nh", F.col("chrom").alias("ca"), F.col("blocks").alias("ba"))
    return both.unionByName(one, allowMissingColumns=True)


def discordance(pairs: DataFrame) -> DataFrame:
    """``oriented`` pairs with ``code``: 0 agree, 1 and 2 a block in the other's intron, 3 one within the other; 0 across chromosomes."""
    code = C.discordance(F.col("blocks_a"), F.col("blocks_b"))
    return pairs.withColumn("code", F.when(F.col("chrom_a") == F.col("chrom_b"), code).otherwise(0))


def infer_strand(reads: DataFrame) -> DataFrame:
    """Records without a strand take their mate's."""
    both = mate_pairs(reads).select(F.inline(F.array(F.struct(F.col("line_a").alias("line_no"), F.col("line_b").alias("mate")), F.struct(F.col("line_b").alias("line_no"), F.col("line_a").alias("mate")))))
    mates = both.join(reads.select(F.col("line_no").alias("mate"), F.col("strand").alias("_strand")), "mate").drop("mate")
    return reads.join(mates, "line_no", "left").withColumn("strand", F.coalesce("strand", "_strand")).select(reads.columns)


def enumerated(left: DataFrame, right: DataFrame) -> DataFrame:
    """All-against-all pairs of a name's left and right records, unless they match one to one.

    (qname, line_a, line_b, nh): where the places of both sides mirror each other as multisets, rows are the records themselves (the
    other line null) and nh their side's number; else every pair, with the product of both numbers.
    """
    place = lambda a, b: F.sort_array(F.collect_list(F.struct(F.col(a).alias("p"), F.col(b).alias("q"))))
    a = left.groupBy("qname").agg(place("pos", "mate_pos").alias("x"), F.count("*").alias("na"))
    b = right.groupBy("qname").agg(place("mate_pos", "pos").alias("y"), F.count("*").alias("nb"))
    names = a.join(b, "qname").withColumn("one", F.col("x") == F.col("y")).select("qname", "na", "nb", "one")
    none = F.lit(None).cast("long")
    alone = left.join(names.where("one"), "qname").select("qname", F.col("line_no").alias("line_a"), none.alias("line_b"), F.col("na").alias("nh"))
    alone = alone.union(right.join(names.where("one"), "qname").select("qname", none, "line_no", "nb"))
    many = left.select("qname", F.col("line_no").alias("line_a")).join(names.where("not one"), "qname").join(right.select("qname", F.col("line_no").alias("line_b")), "qname")
    return alone.union(many.select("qname", "line_a", "line_b", (F.col("na") * F.col("nb")).alias("nh")))


def infer_record_strand(records: DataFrame) -> DataFrame:
    """Raw records with a strand tag where they or their mate have one. The tag is added at the end of a record's tags."""
    paired = R.mate_chrom(F.col("rnext"), F.col("rname"))
    mates = records.select("line_no", "qname", F.col("rname").alias("chrom"), "pos", paired.alias("mate_chrom"), F.when(paired.isNotNull(), F.col("pnext")).alias("mate_pos"), R.strand(F.col("tags")).alias("strand"))
    told = infer_strand(mates).select("line_no", F.col("strand").alias("_strand"))
    added = F.concat_ws("\t", F.when(F.col("tags") != "", F.col("tags")), F.concat(F.lit("XS:A:"), "_strand"))
    tags = F.when(R.strand(F.col("tags")).isNull() & F.col("_strand").isNotNull(), added).otherwise(F.col("tags"))
    return records.join(told, "line_no").withColumn("tags", tags).select(records.columns)


def enumerated_records(records: DataFrame, hold=lambda df: df) -> DataFrame:
    """Raw records in which names with several left and right records stand in every pair of them.

    Left and right are told by the FLAG. Where a name's places on both sides mirror each other the records stay, with their side's number
    as NH. Else each left record meets each right one: both stand once for each pair, with the other as mate and the product of the
    numbers as NH; a record without a CIGAR takes that of a mate at its place. Records of no side, and of names with one side, stay as
    they are. Lines are numbered anew in the order of the old ones; ``hold`` may write them, so that the numbers stay.
    """
    first, second = R.has(F.col("flag"), R.FIRST), R.has(F.col("flag"), R.SECOND)
    sided = records.withColumn("_side", F.when(first & ~second, 0).when(second & ~first, 1))
    place = lambda *c: F.sort_array(F.collect_list(F.when(F.col("_side") == c[0], F.struct(F.col(c[1]).alias("p"), F.col(c[2]).alias("q")))))
    names = sided.where("_side is not null").groupBy("qname").agg(place(0, "pos", "pnext").alias("x"), place(1, "pnext", "pos").alias("y"), F.count_if(F.col("_side") == 0).alias("na"), F.count_if(F.col("_side") == 1).alias("nb"))
    names = names.select("qname", "na", "nb", (F.col("x") == F.col("y")).alias("one")).where("na > 0 and nb > 0")
    known = sided.join(names, "qname", "left")
    stay = known.where("_side is null or one is null or one")
    number = F.when(F.col("_side").isNotNull() & F.col("one"), F.when(F.col("_side") == 0, F.col("na")).otherwise(F.col("nb")))
    stay = stay.withColumn("tags", with_hits(F.col("tags"), number)).withColumn("_order", F.struct(F.col("line_no").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("c")))
    many = known.where("_side is not null and not one")
    left, right = many.where("_side = 0"), many.where("_side = 1").select("qname", *(F.col(c).alias(f"_{c}") for c in records.columns if c != "qname"))
    met = left.join(right, "qname")

    def side(own: str, mate: str, c: int) -> DataFrame:
        new = {x: F.col(f"{own}{x}") for x in records.columns if x != "qname"} | {"qname": F.col("qname")}
        at_mate = (F.col(f"{own}rname") == F.col(f"{mate}rname")) & (F.col(f"{own}pos") == F.col(f"{mate}pos"))
        new["cigar"] = F.when((new["cigar"] == "*") & at_mate, F.col(f"{mate}cigar")).otherwise(new["cigar"])
        new["rnext"] = F.when(F.col(f"{own}rname") == F.col(f"{mate}rname"), F.lit("=")).otherwise(F.col(f"{mate}rname"))
        new["pnext"] = F.col(f"{mate}pos")
        new["tags"] = with_hits(new["tags"], F.col("na") * F.col("nb"))
        order = F.struct(F.col("line_no").alias("a"), F.col("_line_no").alias("b"), F.lit(c).alias("c"))
        return met.select(*(new[x].alias(x) for x in records.columns), order.alias("_order"))

    every = stay.select(*records.columns, "_order").union(side("", "_", 0)).union(side("_", "", 1))
    return hold(every.repartitionByRange("_order").sortWithinPartitions("_order").withColumn("line_no", F.monotonically_increasing_id()).select(records.columns))


def with_hits(tags, n):
    """Tags with NH set to ``n`` where that is not null."""
    rest = F.array_join(F.filter(F.split(tags, "\t"), lambda t: ~t.startswith("NH:i:") & (t != "")), "\t")
    return F.when(n.isNotNull(), F.concat_ws("\t", F.concat(F.lit("NH:i:"), n.cast("string")), F.when(rest != "", rest))).otherwise(tags)
