"""The steps from reads to buckets, each built when first asked for. Those that several others read are written as tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import buckets, bundles, coverage, pairing
from ..sources import fixtures
from .tables import held, version_of


class Steps:
    """``cutoff`` and ``points`` (annotated ends, chrom and p) as in ``bundles``; ``split_discordant`` as in ``buckets.fragments``."""

    def __init__(self, reads: DataFrame, cutoff: int | None, points: DataFrame | None = None, split_discordant: bool = False, split_strands: bool = False):
        self.source, self.cutoff, self.points = reads, cutoff, points
        self.split_discordant, self.split_strands = split_discordant, split_strands

    @cached_property
    def reads(self) -> DataFrame:
        """The records with their blocks, parsed once."""
        return held(bundles.parsed(self.source))

    @cached_property
    def segments(self) -> DataFrame:
        return held(coverage.segments(bundles.filled(self.reads).select("chrom", "nh", F.inline("blocks")), hold=held))

    @cached_property
    def pairs(self) -> DataFrame:
        found = pairing.mate_pairs(self.reads)
        if self.split_strands:
            found = found.join(pairing.different_strands(found, self.reads).select("line_a"), "line_a", "left_anti")
        return held(found)

    @cached_property
    def extents(self) -> DataFrame:
        return bundles.extents(bundles.filled(self.reads), self.cutoff)

    @cached_property
    def starts(self) -> DataFrame:
        return held(bundles.islands(self.extents, hold=held))

    @cached_property
    def bundles(self) -> DataFrame:
        return bundles.bundles(self.starts)

    @cached_property
    def rows(self) -> DataFrame:
        return held(bundles.assigned(self.extents, self.starts))

    @cached_property
    def breakpoints(self) -> DataFrame:
        return bundles.breakpoints(self.rows, self.bundles, self.points)

    @cached_property
    def subexons(self) -> DataFrame:
        return held(bundles.subexons(self.breakpoints))

    @cached_property
    def incidences(self) -> DataFrame:
        return held(buckets.incidences(self.rows, self.subexons))

    @cached_property
    def paths(self) -> DataFrame:
        return buckets.read_paths(self.incidences)

    @cached_property
    def fragments(self) -> DataFrame:
        return held(buckets.fragments(self.rows, self.paths, self.pairs, self.split_discordant))

    @cached_property
    def buckets(self) -> DataFrame:
        return held(buckets.buckets(self.fragments))

    @cached_property
    def elements(self) -> DataFrame:
        return held(buckets.elements(self.buckets, self.subexons))

    @cached_property
    def lengths(self) -> DataFrame:
        return buckets.lengths(self.fragments, self.rows, self.elements)

    @cached_property
    def cover(self) -> DataFrame:
        return buckets.bucket_coverage(buckets.local_blocks(self.fragments, self.incidences, self.elements))


_KNOWN: dict[tuple, object] = {}


def known(spark: SparkSession, sf_dir: str, kind: str, make):
    """What ``make`` gives, made once for an application and the files of the events."""
    key = (spark.sparkContext.applicationId, sf_dir, version_of(spark, f"{sf_dir}/events.parquet"), kind)
    if key not in _KNOWN:
        _KNOWN[key] = make()
    return _KNOWN[key]


def steps(spark: SparkSession, sf_dir: str) -> Steps:
    """The steps over the derived alignments. Queries of one application over the same files share them, as queries of a store share
    its tables: the first that needs a step writes it."""
    return known(spark, sf_dir, "steps", lambda: Steps(fixtures.reads(spark, sf_dir), fixtures.CUTOFF))


def annotated_steps(spark: SparkSession, sf_dir: str) -> Steps:
    """The same with the annotation's exon ends as breakpoints, on the same bundles."""
    plain = steps(spark, sf_dir)
    points = fixtures.annotation(spark, sf_dir).select("chrom", F.explode(F.array("s", "e")).alias("p"))
    other = Steps(plain.source, plain.cutoff, points)
    other.__dict__ |= {"reads": plain.reads, "starts": plain.starts, "rows": plain.rows}
    return other
