"""The store: an ingested set of alignments as Parquet tables, and the queries over it.

What the store is made of are aggregates: bundles, subexons, segments of depth, and for each bucket its path, its runs of coverage and
its histograms of lengths. All queries work from these; reads are rebuilt, approximately, while coverage and counts are exact. With
``exact`` the records themselves are stored beside them, and ``reads`` and ``sam`` can return them as they were.

Tables are partitioned by chromosome and sorted by start within it, so a region reads the files and row groups it overlaps. A store
is written under a name of its own and named by a file when it is whole, so an ingest that fails leaves the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import cigar as C
from ..operators import buckets, counts, coverage, intervals, preprocess, reconstruct, sinks
from .context import Steps
from .tables import bytes_of, deleted, held

__all__ = ["Bundle", "Store", "ingest", "__version__"]

TABLES = ["chroms", "bundles", "subexons", "segments", "buckets", "elements", "lengths", "bucket_coverage", "rows", "fragments"]
SORTED = {"rows": ["chrom", "s"], "bundles": ["chrom", "s"], "segments": ["chrom", "s"], "subexons": ["chrom", "s"], "elements": ["chrom_e", "s"]}


class Bundle:
    """What an iteration over a store gives: one bundle, and what can be asked about it."""

    def __init__(self, store: Store, chrom: str, start: int, end: int):
        self.store, self.chrom, self.start, self.end = store, chrom, start, end

    def coverage(self) -> DataFrame:
        return self.store.coverage(self.chrom, self.start, self.end)

    def alignments(self) -> DataFrame:
        return self.store.rebuilt_reads(self.chrom, self.start, self.end)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @cached_property
    def whole(self) -> str:
        """The folder of the tables."""
        return f"{self.path}/{self.spark.read.text(f'{self.path}/current').first()[0]}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.whole}/{name}")

    def has(self, name: str) -> bool:
        return bytes_of(self.spark, f"{self.whole}/{name}") > 0

    def chroms(self) -> DataFrame:
        return self.table("chroms").orderBy("ord")

    def bundles(self, chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Bounds of the bundles that overlap [start, end); of all chromosomes if none is named."""
        if chrom is None:
            return self.table("bundles").select("chrom", "s", "e")
        return intervals.in_range(self.table("bundles"), chrom, start, end).select("s", "e")

    def __iter__(self) -> Iterator[Bundle]:
        """The bundles by chromosome and place; one partition of their bounds at a time comes to the driver."""
        for r in self.bundles().orderBy("chrom", "s").toLocalIterator():
            yield Bundle(self, r["chrom"], r["s"], r["e"])

    def coverage(self, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """Segments of NH-weighted depth within the range."""
        low, high = self._range(chrom, start, end)
        return coverage.clipped(intervals.in_range(self.table("segments"), chrom, low, high), low, high).select("s", "e", "v")

    def coverage_vector(self, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """(s, cov): the depth of every place of the range, in vectors of bounded length."""
        low, high = self._range(chrom, start, end)
        return coverage.dense(intervals.in_range(self.table("segments"), chrom, low, high), low, high)

    def _range(self, chrom: str, start: int | None, end: int | None) -> tuple[int, int]:
        row = self.table("chroms").where(F.col("chrom") == chrom).first()
        if row is None:
            raise ValueError(f"no chromosome {chrom}")
        return max(start or 0, 0), row["chrom_len"] if end is None else min(end, row["chrom_len"])

    def reads(self, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """Stored fragments (``exact``) of which a record has a block in the range."""
        low, high = self._range(chrom, start, end)
        rows = intervals.in_range(self.table("rows"), chrom, low, high, "s", "last")
        hit = rows.where(C.overlaps(F.col("blocks"), F.lit(low), F.lit(high))).select("line_no")
        frags = self.table("fragments").select("frag", "line_a", "line_b", "strand", "nh")
        return frags.join(hit.select(F.col("line_no").alias("line_a")), "line_a", "left_semi").union(
            frags.join(hit.select(F.col("line_no").alias("line_b")), "line_b", "left_semi").select(frags.columns)
        ).distinct()

    def placed(self) -> DataFrame:
        """Stored fragments (``exact``) with both records' chromosomes and blocks."""
        return sinks.placed_fragments(self.table("fragments"), self.table("rows"))

    def rebuilt_reads(self, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """Fragments rebuilt from the aggregates of which a record has a block in the range. Only buckets with a subexon in the range,
        those of pairs between bundles by either of their bundles, are rebuilt."""
        low, high = self._range(chrom, start, end)
        ids = held(buckets.relevant(self.table("elements"), chrom, low, high))
        near = lambda c, b: (F.col(c) == chrom) & C.overlaps(F.col(b), F.lit(low), F.lit(high))
        return self.decompress(ids).where(F.coalesce(near("ca", "ba"), F.lit(False)) | F.coalesce(near("cb", "bb"), F.lit(False)))

    def counts(self, annotation: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Exon and junction counts for (transcript_id, chrom, exon, s, e)."""
        cover, els = self.table("bucket_coverage"), self.table("elements")
        return counts.exon_counts(cover, els, self.table("lengths"), counts.exons(annotation)), counts.junction_counts(cover, els, counts.junctions(annotation))

    def decompress(self, ids: DataFrame | None = None) -> DataFrame:
        """Fragments rebuilt from the aggregates, with genomic blocks; ``ids``: of these buckets only."""
        some = (lambda df: df) if ids is None else (lambda df: df.join(ids, buckets.ID, "left_semi"))
        els = some(self.table("elements"))
        reads = reconstruct.rebuilt(els, some(self.table("bucket_coverage")), some(self.table("lengths")))
        return reconstruct.lifted(held(reads), els, some(self.table("buckets")))

    def decompress_sam(self, path: str, force_strand: bool = False) -> None:
        """All fragments, rebuilt, as alignment text with a header."""
        sinks.write_sam(self.decompress(), self.chroms(), path, force_strand)

    def sizes(self) -> dict[str, int]:
        """Bytes of each table."""
        return {name: bytes_of(self.spark, f"{self.whole}/{name}") for name in TABLES}

    def coverage_share(self) -> float:
        """The runs of coverage' share of the aggregates' bytes."""
        sizes = self.sizes()
        return sizes["bucket_coverage"] / max(1, sum(sizes[t] for t in ("buckets", "lengths", "bucket_coverage")))


def ingest(
    reads: DataFrame,
    chroms: DataFrame,
    path: str,
    annotation: DataFrame | None = None,
    cutoff: int | None = None,
    z: float = 0.125,
    split_strands: bool = False,
    split_discordant: bool = False,
    exact: bool = True,
    codec: str = "zstd",
    intermediate: str | None = None,
    steps: Steps | None = None,
) -> Store:
    """Write the store's tables. Without a ``cutoff`` it is derived from the fragment lengths by ``z``. ``codec``: Parquet's compression
    (zstd, gzip, snappy, none). ``intermediate``: where to write the fragments as alignment text before they are aggregated. ``steps``:
    those of these reads, if some were built already."""
    spark = reads.sparkSession
    if steps is None:
        if cutoff is None:
            cutoff = preprocess.cutoff(reads, z).first()["cutoff"] or 0
        points = None if annotation is None else annotation.select("chrom", F.explode(F.array("s", "e")).alias("p"))
        steps = Steps(reads, cutoff, points, split_discordant, split_strands)
    rows = steps.rows.withColumn("last", F.element_at("blocks", -1)["e"])
    out = {
        "chroms": chroms,
        "bundles": steps.bundles,
        "subexons": steps.subexons,
        "segments": steps.segments,
        "buckets": steps.buckets,
        "elements": steps.elements,
        "lengths": steps.lengths,
        "bucket_coverage": steps.cover,
    }
    if exact:
        out |= {"rows": rows, "fragments": steps.fragments}
    if intermediate:
        sinks.write_sam(sinks.placed_fragments(steps.fragments, rows), chroms, intermediate)
    name = f"tables-{uuid.uuid4().hex}"
    for table, df in out.items():
        writer = df
        if table in SORTED:
            writer = df.repartitionByRange(*SORTED[table]).sortWithinPartitions(*SORTED[table])
        writer = writer.write.option("compression", codec)
        (writer if table == "chroms" else writer.partitionBy(SORTED.get(table, ["chrom"])[0])).parquet(f"{path.rstrip('/')}/{name}/{table}")
    before = Store(spark, path).whole if bytes_of(spark, f"{path.rstrip('/')}/current") else None
    spark.range(1).select(F.lit(name).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/current")
    if before:
        deleted(spark, before)
    return Store(spark, path)
