"""Queries over the derived alignments: (spark, sf_dir) -> DataFrame with scalar columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import records as R
from ..functions import runs as V
from ..operators import buckets, bundles, counts, coverage, evaluate, intervals, pairing, preprocess, reconstruct, sinks
from ..sources import fixtures as X
from ..sources import text as T
from .context import annotated_steps, known, steps
from .engine import Store, ingest
from .tables import folder, held

#: The range of the region queries (fixed values).
CHROM, START, END = "view", 20000, 60000
QUERIES: dict[str, Callable[..., DataFrame]] = {}


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    QUERIES[f.__name__] = f
    return f


def path(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def rounded(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query
def cigar_blocks(s, d):
    return X.reads(s, d).select("line_no", F.posexplode(C.blocks(F.col("cigar"), F.col("pos"))).alias("block", "b")).select("line_no", "block", "b.s", "b.e")


@query
def cigar_ref_length(s, d):
    return X.reads(s, d).select("line_no", C.reference_length(F.col("cigar")).alias("n"))


@query
def flag_bits(s, d):
    f = F.col("flag")
    return X.records(s, d).select("line_no", R.has(f, R.UNMAPPED).alias("unmapped"), R.has(f, R.MATE_UNMAPPED).alias("mate_unmapped"), R.has(f, R.FIRST).alias("first_mate"), R.has(f, R.SECOND).alias("second_mate"))


@query
def tag_extract(s, d):
    return X.records(s, d).select("line_no", R.strand(F.col("tags")).alias("strand"), R.hits(F.col("tags")).alias("nh"))


@query
def rnext_resolve(s, d):
    return X.records(s, d).select("line_no", R.mate_chrom(F.col("rnext"), F.col("rname")).alias("mate_chrom"))


@query
def chrom_offsets(s, d):
    return X.chromosomes(s, d).select("chrom", "chrom_len", F.expr("coalesce(sum(chrom_len + 1) over (order by ord rows between unbounded preceding and 1 preceding), 0) + 1").alias("start"))


@query
def sam_filter_mapped(s, d):
    return preprocess.mapped(X.records(s, d)).select("line_no", "qname", "rname", "pos")


@query
def sortedness_check(s, d):
    return preprocess.unsorted(X.records(s, d)).select("line_no", "rname", "pos")


@query
def strip_unpaired_tag(s, d):
    return preprocess.remove_unmapped(X.records(s, d)).select("line_no", "rname", "tags")


@query
def remove_pairing(s, d):
    return preprocess.remove_pairing(X.records(s, d), only_unmapped_mates=True).select("line_no", "flag", "rnext", "pnext", "tlen")


@query
def filter_by_length(s, d):
    return preprocess.of_length(X.reads(s, d), 78).select("line_no", "cigar")


@query
def frag_len_hist(s, d):
    return preprocess.fragment_lengths(X.reads(s, d))


@query
def frag_len_cutoff(s, d):
    return preprocess.cutoff(X.reads(s, d)).select("n", rounded("mean"), rounded("sd"), "cutoff")


@query
def long_fragment_share(s, d):
    return preprocess.long_share(X.reads(s, d), X.CUTOFF).select(rounded("percent"))


@query
def mate_pairs(s, d):
    return steps(s, d).pairs


@query
def unmatched_reads(s, d):
    reads = X.reads(s, d).withColumn("qname", F.expr("case when line_no % 19 = 3 then concat(qname, 'x') else qname end"))
    return pairing.unmatched(reads, pairing.mate_pairs(reads)).select("line_no", "qname")


@query
def diff_strand_pairs(s, d):
    reads = X.reads(s, d).withColumn("strand", F.expr("case when line_no % 6 = 1 then '-' else strand end"))
    return pairing.different_strands(pairing.mate_pairs(reads), reads)


@query
def infer_xs(s, d):
    reads = X.reads(s, d).withColumn("strand", F.expr("case when line_no % 2 = 0 then strand end"))
    return pairing.infer_strand(reads).select("line_no", "strand")


@query
def enumerate_pairs(s, d):
    reads = X.reads(s, d).where("mate_pos is not null").withColumn("qname", F.expr("case when line_no % 10 = 1 then concat('h', line_no) else concat('g', line_no div 6) end"))
    left, right = reads.where("line_no % 2 = 0"), reads.where("line_no % 2 = 1")
    return pairing.enumerated(left, right)


@query
def discordance_class(s, d):
    x = steps(s, d)
    return pairing.discordance(pairing.oriented(x.pairs, x.extents)).select("line_a", "line_b", "code")


@query
def bundle_of_read(s, d):
    return steps(s, d).rows.select("line_no", "chrom", "bundle_id")


@query
def bundle_ranges(s, d):
    return steps(s, d).bundles


@query
def bundles_in_range(s, d):
    return intervals.in_range(steps(s, d).bundles, CHROM, START, END).select("chrom", "s", "e")


@query
def bundle_stats(s, d):
    return bundles.stats(steps(s, d).bundles).select("bundles", "shortest", "longest", rounded("mean_length"))


@query
def genes_raw(s, d):
    """Spans of pairs as records name them, merged where 50 apart or less."""
    rows = bundles.with_blocks(X.reads(s, d))
    far = F.coalesce((F.col("mate_chrom") == F.col("chrom")) & (F.col("mate_pos") > F.col("pos")), F.lit(False))
    spans = rows.select("chrom", F.get("blocks", F.lit(0))["s"].alias("s"), F.when(far, F.col("mate_pos")).otherwise(F.element_at("blocks", -1)["e"]).alias("e"))
    return bundles.bundles(bundles.islands(spans, hold=held)).select("chrom", "s", "e")


@query
def breakpoints(s, d):
    return steps(s, d).breakpoints


@query
def breakpoints_annotated(s, d):
    return annotated_steps(s, d).breakpoints


@query
def subexons(s, d):
    return steps(s, d).subexons


@query
def subexon_prefix(s, d):
    return bundles.prefix(steps(s, d).subexons)


@query
def read_subexons(s, d):
    return steps(s, d).incidences.groupBy("line_no", "subexon_id").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))


@query
def read_paths(s, d):
    return steps(s, d).paths.select("line_no", "bundle_id", path("path"))


@query
def fragment_paths(s, d):
    return steps(s, d).fragments.where("not cross").select("frag", "line_b", "chrom", "bundle_id", path("path"), "strand", "nh")


@query
def cross_bundle_pairs(s, d):
    return steps(s, d).fragments.where("cross").select("line_a", "line_b", "bundle_id", "bundle_id_b", path("path_a"), path("path_b"))


@query
def bucket_sizes(s, d):
    return steps(s, d).buckets.where("not cross").select("chrom", "bundle_id", path("path"), "strand", "nh", "n_unpaired", "n_paired")


@query
def cross_buckets(s, d):
    return steps(s, d).buckets.where("cross").select("chrom", "bundle_id", path("path_a"), "bundle_id_b", path("path_b"), "strand", "nh", F.col("n_paired").alias("n"))


def _named(x, rows: DataFrame) -> DataFrame:
    """Rows of buckets with the bucket's path, strand and NH; pairs between bundles are buckets, too."""
    return rows.join(x.buckets.select(*buckets.ID, buckets.label().alias("path"), "strand", "nh"), buckets.ID)


def _lengths(s, d, *kinds):
    x = steps(s, d)
    return _named(x, x.lengths.where(F.col("kind").isin(*kinds))).select("chrom", "bundle_id", "path", "strand", "nh", "kind", "len", "freq")


@query
def bucket_unpaired_lens(s, d):
    return _lengths(s, d, "unpaired")


@query
def bucket_paired_lens(s, d):
    return _lengths(s, d, "paired")


@query
def bucket_left_right_lens(s, d):
    return _lengths(s, d, "left", "right")


@query
def bucket_coverage_rle(s, d):
    x = steps(s, d)
    return _named(x, x.cover).select("chrom", "bundle_id", "path", "strand", "nh", "s", "e", "v")


@query
def bucket_elements(s, d):
    x = steps(s, d)
    return _named(x, x.elements.drop("nh")).select("chrom", "bundle_id", "path", "strand", "nh", "k", "subexon_id", "bundle_e", "s", "e", "off", "total")


@query
def buckets_in_range(s, d):
    """Buckets with a subexon in the range, those of pairs between bundles by either of their bundles."""
    x = steps(s, d)
    return _named(x, buckets.relevant(x.elements, CHROM, START, END)).select("chrom", "bundle_id", "path", "strand", "nh")


@query
def coverage_from_buckets(s, d):
    """The depth of all reads, from buckets' runs of coverage alone."""
    x = steps(s, d)
    runs = buckets.lifted_coverage(x.cover, x.elements).select(F.col("chrom_e").alias("chrom"), "s", "e", "v", "nh")
    return coverage.segments(runs, weight="cast(v as double) / nh", hold=held).select("chrom", "s", "e", rounded("v"))


@query
def longest_read_of_bundle(s, d):
    return buckets.longest_reads(steps(s, d).rows)


@query
def duplicate_reads(s, d):
    return buckets.collapsed(steps(s, d).rows)


def _segments(s, d):
    return steps(s, d).segments


@query
def coverage_segments(s, d):
    return _segments(s, d).select("chrom", "s", "e", rounded("v"))


@query
def coverage_region(s, d):
    return coverage.clipped(intervals.in_range(_segments(s, d), CHROM, START, END), START, END).select("s", "e", rounded("v"))


@query
def coverage_dense_region(s, d):
    runs = intervals.in_range(_segments(s, d), CHROM, START, START + 2000)
    vectors = coverage.dense(runs, START, START + 2000, block=300).select("s", F.posexplode("cov").alias("i", "v"))
    return vectors.select((F.col("s") - START + F.col("i")).alias("i"), rounded("v"))


@query
def coverage_point(s, d):
    return _segments(s, d).where("s <= 20300 and e > 20300").select("chrom", rounded("v"))


@query
def coverage_range_sum(s, d):
    runs = coverage.clipped(intervals.in_range(_segments(s, d), CHROM, START, END), START, END)
    return runs.agg(F.round(F.sum((F.col("e") - F.col("s")) * F.col("v")), 6).alias("total"), F.sum(F.col("e") - F.col("s")).alias("covered"))


@query
def run_length_vectors(s, d):
    """Encoding, decoding, lookup, range sum and range add of a small vector for each part."""
    dense = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("p_partkey") + i * i) % 5).cast("long"))
    runs = s.read.parquet(f"{d}/part.parquet").select("p_partkey", V.encode(dense).alias("r"))
    low, high = F.lit(3).cast("long"), F.lit(8).cast("long")
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    added = V.decode(V.range_add(F.col("r"), low, high, F.lit(2).cast("long")))
    return runs.select("p_partkey", F.size("r").cast("long").alias("runs"), text(V.decode(F.col("r"))).alias("dense"), V.value_at(F.col("r"), F.lit(7).cast("long")).alias("at7"), V.range_sum(F.col("r"), low, high).alias("sum38"), text(added).alias("added"))


@query
def bytes_needed(s, d):
    return X.reads(s, d).select("line_no", R.bytes_needed(F.col("pos")).alias("n"))


@query
def reads_in_region(s, d):
    rows = bundles.with_blocks(X.reads(s, d)).where(F.col("chrom") == CHROM)
    return rows.where(C.overlaps(F.col("blocks"), F.lit(START), F.lit(END))).select("line_no", "qname", "pos")


@query
def pairs_in_region(s, d):
    x = steps(s, d)
    met = pairing.joined(x.pairs, bundles.filled(x.reads).where(F.col("chrom") == CHROM), ["chrom", "blocks"])
    hit = lambda c: C.overlaps(F.col(c), F.lit(START), F.lit(END))
    return met.where(hit("blocks_a") | hit("blocks_b")).select("line_a", "line_b")


@query
def gtf_exons(s, d):
    return counts.exons(X.annotation(s, d))


@query
def gtf_junctions(s, d):
    return counts.junctions(X.annotation(s, d))


@query
def exon_counts(s, d):
    x = steps(s, d)
    return counts.exon_counts(x.cover, x.elements, x.lengths, counts.exons(X.annotation(s, d))).select("chrom", "s", "e", rounded("x"))


@query
def junction_counts(s, d):
    x = steps(s, d)
    return counts.junction_counts(x.cover, x.elements, counts.junctions(X.annotation(s, d))).select("chrom", "s", "e", rounded("x"))


@query
def blocks_to_cigar(s, d):
    return bundles.with_blocks(X.reads(s, d)).select("line_no", C.to_cigar(F.col("blocks")).alias("cigar"))


def _placed(s, d):
    """All fragments with the records' blocks: pairs, and the records without a mate. Neither bundles nor paths are needed."""
    x = steps(s, d)
    rows = held(bundles.filled(x.reads).select("line_no", "chrom", "blocks", "strand", "nh"))
    return pairing.placed_fragments(x.pairs, rows)


@query
def sam_lines(s, d):
    return sinks.sam_lines(_placed(s, d)).select("frag", "side", "line")


@query
def force_xs(s, d):
    return sinks.sam_lines(_placed(s, d), force_strand=True).where("side = 'a'").select("frag", F.regexp_extract("line", "XS:A:(.)", 1).alias("strand"))


@query
def transcript_score_reciprocal(s, d):
    return evaluate.reciprocal_scores(X.annotation(s, d), X.other_annotation(s, d)).select("a", "b", rounded("score"))


@query
def transcript_score_product(s, d):
    return evaluate.product_scores(X.annotation(s, d), X.other_annotation(s, d)).select("a", "b", rounded("score"))


@query
def transcript_score_overlap(s, d):
    return evaluate.overlap_scores(X.annotation(s, d), X.other_annotation(s, d)).select("a", "b", rounded("score"))


@query
def quant_outer_join(s, d):
    return evaluate.matched(X.quantified(s, d, 3, 1.0), X.quantified(s, d, 7, 1.25)).select("transcript_id", rounded("x"), rounded("y"))


@query
def quant_rmse(s, d):
    return evaluate.rmse(evaluate.matched(X.quantified(s, d, 3, 1.0), X.quantified(s, d, 7, 1.25))).select(rounded("rmse"), rounded("corr"))


@query
def tophat_records(s, d):
    return preprocess.tophat(X.records(s, d)).select("qname", "flag", "rname", "pos", "rnext", "pnext", "tags")


@query
def hisat_records(s, d):
    names = X.records(s, d).withColumn("qname", F.expr("concat('g', line_no div 6)"))
    return preprocess.hisat(names, hold=held).select("qname", "flag", "rname", "pos", "rnext", "pnext", "tags")


def _rebuilt(s, d):
    x = steps(s, d)
    return _named(x, reconstruct.rebuilt(x.elements, x.cover, x.lengths))


@query
def reconstruct_reads(s, d):
    return _rebuilt(s, d).where("kind = 'unpaired'").select("chrom", "bundle_id", "path", "strand", "nh", "n", "s", "e")


@query
def reconstruct_pairs(s, d):
    return _rebuilt(s, d).where("kind = 'paired'").select("chrom", "bundle_id", "path", "strand", "nh", "n", "s", "e", "s_b", "e_b")


@query
def rebuilt_coverage(s, d):
    """The depth of the rebuilt reads by bucket: that of the reads they were rebuilt from."""
    x = steps(s, d)
    sides = F.array(F.struct(F.col("s"), F.col("e")), F.struct(F.col("s_b").alias("s"), F.col("e_b").alias("e")))
    spans = reconstruct.rebuilt(x.elements, x.cover, x.lengths).select(*buckets.ID, F.inline(sides)).where("s is not null")
    return _named(x, buckets.bucket_coverage(spans)).select("chrom", "bundle_id", "path", "strand", "nh", "s", "e", "v")


def _written(s, lines: DataFrame) -> str:
    """Lines of text in a file of the shared folder."""
    path = f"{folder(s)}/text/{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


@query
def sam_text_records(s, d):
    """Records written as alignment text and read back."""
    fixed = [F.col(c).cast("string") for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen")]
    lines = X.records(s, d).select(F.concat_ws("\t", *fixed, F.lit("*"), F.lit("*"), "tags").alias("line"))
    head = s.range(1).select(F.lit("@HD\tVN:1.0").alias("line"))
    return T.sam_records(s, _written(s, head.union(lines))).select("qname", "flag", "rname", "pos", "cigar", "rnext", "pnext", "tags")


@query
def sam_text_reads(s, d):
    """Mapped records of alignment text as reads."""
    fixed = [F.col(c).cast("string") for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen")]
    lines = X.records(s, d).select(F.concat_ws("\t", *fixed, F.lit("*"), F.lit("*"), "tags").alias("line"))
    return T.reads_of(T.sam_records(s, _written(s, lines))).select("qname", "chrom", "pos", "cigar", "mate_chrom", "mate_pos", "strand", "nh")


@query
def sam_text_header(s, d):
    return T.sam_header(s, _written(s, sinks.header_lines(X.chromosomes(s, d)).coalesce(1).sortWithinPartitions("ord").select("line"))).select("chrom", "chrom_len", F.col("ord").cast("long").alias("ord"))


def _gtf(s, d):
    line = lambda feature, s, e, attributes: F.concat_ws("\t", "chrom", F.lit("x"), F.lit(feature), s, e, F.lit("."), F.lit("+"), F.lit("."), attributes).alias("line")
    name = F.concat(F.lit('gene_id "g"; transcript_id "'), "transcript_id", F.lit('";'))
    exons = X.annotation(s, d).select(line("exon", F.col("s").cast("string"), (F.col("e") - 1).cast("string"), name))
    whole = X.annotation(s, d).groupBy("transcript_id", "chrom").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    whole = whole.select(line("transcript", F.col("s").cast("string"), F.col("e").cast("string"), F.concat(name, F.lit(' FPKM "'), (F.col("transcript_id") * 0.25).cast("string"), F.lit('";'))))
    return T.gtf(s, _written(s, exons.union(whole)))


@query
def gtf_text_exons(s, d):
    return T.gtf_exons(_gtf(s, d)).select("transcript_id", "chrom", F.col("exon").cast("int").alias("exon"), "s", "e")


@query
def gtf_text_quantities(s, d):
    return T.gtf_quantities(_gtf(s, d)).select("transcript_id", rounded("fpkm"))


@query
def profile_bounds(s, d):
    lines = X.annotation(s, d).select(F.concat_ws("\t", F.concat("chrom", F.lit(":"), F.col("s") + 10, F.lit("-"), F.col("e") + 10, F.lit("W")), "transcript_id", F.lit("CDS"), F.lit("1"), F.lit("2")))
    return T.gene_bounds(s, _written(s, lines))


@query
def log_peak(s, d):
    head = s.range(1).select(F.lit("PID A B C D E MEM F").alias("line"))
    lines = s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("  1   2 3 4  5 6 "), (F.col("event_id") * 7919 % 10007).cast("string"), F.lit(" x")))
    return T.peak_memory(s, _written(s, head.union(lines)))


def _store(s, d) -> Store:
    """The derived alignments as a store, written once for an application."""
    make = lambda: ingest(X.reads(s, d), X.chromosomes(s, d), f"{folder(s)}/stores/{uuid.uuid4().hex}", steps=steps(s, d))
    return known(s, d, "store", make)


@query
def store_chroms(s, d):
    return _store(s, d).chroms().select("chrom", "chrom_len", F.col("ord").cast("long").alias("ord"))


@query
def store_bundles(s, d):
    return _store(s, d).bundles(CHROM, START, END).withColumn("chrom", F.lit(CHROM)).select("chrom", "s", "e")


@query
def store_coverage(s, d):
    return _store(s, d).coverage(CHROM, START, END).select("s", "e", rounded("v"))


@query
def store_exon_counts(s, d):
    return _store(s, d).counts(X.annotation(s, d))[0].select("chrom", "s", "e", rounded("x"))


@query
def store_junction_counts(s, d):
    return _store(s, d).counts(X.annotation(s, d))[1].select("chrom", "s", "e", rounded("x"))


@query
def store_pairs_in_region(s, d):
    """Stored pairs of which a record has a block in the range."""
    found = _store(s, d).reads(CHROM, START, END).where("line_b is not null")
    return found.select(F.least("line_a", "line_b").alias("line_a"), F.greatest("line_a", "line_b").alias("line_b"))


@query
def store_sam_lines(s, d):
    return sinks.sam_lines(_store(s, d).placed()).select("frag", "side", "line")


@query
def store_decompress(s, d):
    """Depth of all fragments rebuilt from the store, without NH, in genomic places: that of the records."""
    back = _store(s, d).decompress()
    sides = F.array(F.struct(F.col("ca").alias("chrom"), F.col("ba").alias("b")), F.struct(F.col("cb").alias("chrom"), F.col("bb").alias("b")))
    blocks = back.select(F.inline(sides)).where("chrom is not null").select("chrom", F.lit(1).alias("nh"), F.inline("b"))
    return coverage.segments(blocks, hold=held).select("chrom", "s", "e", rounded("v"))
