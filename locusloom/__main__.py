"""Commands over alignment text and stores: ``compress``, ``query`` and ``decompress``.

    python -m locusloom compress [-c N | -z Z] [-s] [-d] [-p tophat|hisat] [-g GTF] [--aggregates-only] [--codec C] in.sam store
    python -m locusloom query (-b | -c | -r | -f --gtf GTF) [--chrom C --start S --end E] store [output]
    python -m locusloom decompress [-f] store out

Stores and alignment text are folders. Results without an output go to standard output, row by row as partitions arrive.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import preprocess, sinks
from .plans.engine import Store, ingest
from .plans.tables import held
from .sources import text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--version", action="version", version=f"locusloom {__version__}")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compress", help="write a store from alignment text")
    c.add_argument("-c", "--frag-len-cutoff", type=int, help="mates farther apart than this don't hold a bundle open")
    c.add_argument("-z", "--frag-len-z-cutoff", type=float, default=0.125, help="the same by deviations from the mean; used without -c")
    c.add_argument("-s", "--split-diff-strands", action="store_true", help="pairs of two strands become unpaired records")
    c.add_argument("-d", "--split-discordant", action="store_true", help="pairs whose blocks disagree become unpaired records")
    c.add_argument("-p", "--preprocess", choices=["tophat", "hisat"], help="prepare this aligner's output first")
    c.add_argument("-g", "--gtf", help="annotation whose exon ends divide bundles, too")
    c.add_argument("-v", "--verbose", action="store_true", help="print times and sizes")
    c.add_argument("--aggregates-only", action="store_true", help="leave the records out of the store")
    c.add_argument("--codec", default="zstd", help="compression of the tables")
    c.add_argument("--intermediate", help="write the fragments as text here before they are aggregated")
    c.add_argument("alignments")
    c.add_argument("compressed", nargs="?", default="compressed.store")
    q = commands.add_parser("query", help="ask a store")
    which = q.add_mutually_exclusive_group(required=True)
    for flag, name in (("-b", "bundles"), ("-c", "coverage"), ("-r", "reads"), ("-f", "counts")):
        which.add_argument(flag, f"--{name}", dest="what", action="store_const", const=name)
    q.add_argument("--chrom")
    q.add_argument("--start", type=int)
    q.add_argument("--end", type=int)
    q.add_argument("--gtf", help="annotation for the counts")
    q.add_argument("compressed")
    q.add_argument("output", nargs="?")
    d = commands.add_parser("decompress", help="rebuild alignment text from a store")
    d.add_argument("-f", "--force-xs", action="store_true", help="spliced fragments without a strand get one")
    d.add_argument("-v", "--verbose", action="store_true", help="print times")
    d.add_argument("compressed")
    d.add_argument("expanded", nargs="?", default="expanded.sam")
    return p


def compress(spark: SparkSession, a: argparse.Namespace) -> Store:
    records, header = text.sam_records(spark, a.alignments), text.sam_header(spark, a.alignments)
    strange = text.unknown_chromosomes(records, header).first()
    if strange is not None:
        raise SystemExit(f"the header doesn't name the chromosome {strange['rname']}")
    if a.preprocess:
        records = preprocess.tophat(records) if a.preprocess == "tophat" else preprocess.hisat(records, held)
    exons = text.gtf_exons(text.gtf(spark, a.gtf)) if a.gtf else None
    return ingest(
        text.reads_of(records), header, a.compressed, exons, a.frag_len_cutoff, a.frag_len_z_cutoff, a.split_diff_strands, a.split_discordant,
        exact=not a.aggregates_only, codec=a.codec, intermediate=a.intermediate,
    )


def result_lines(a: argparse.Namespace, store: Store) -> DataFrame:
    """The answer as a column of text."""
    if a.chrom is None:
        raise SystemExit("--chrom is needed")
    if a.what == "bundles":
        return store.bundles(a.chrom, a.start, a.end).orderBy("s").select(F.concat_ws("\t", "s", "e").alias("line"))
    if a.what == "coverage":
        return store.coverage_vector(a.chrom, a.start, a.end).orderBy("s").select(sinks.vector_text().alias("line"))
    return sinks.sam_lines(store.rebuilt_reads(a.chrom, a.start, a.end)).select("line")


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    store = Store(spark, a.compressed)
    if a.what == "counts":
        if not a.gtf:
            raise SystemExit("--gtf is needed")
        exons, juncs = store.counts(text.gtf_exons(text.gtf(spark, a.gtf)))
        if a.output:
            sinks.write_counts(exons, juncs, a.output)
        else:
            show(df.orderBy("chrom", "s", "e").select(F.concat_ws("\t", "chrom", "s", "e", "x").alias("line")) for df in (exons, juncs))
    elif a.output:
        result_lines(a, store).write.mode("overwrite").text(a.output)
    else:
        show([result_lines(a, store)])


def show(tables) -> None:
    def lines() -> Iterator[str]:
        for df in tables:
            for r in df.toLocalIterator():
                yield r["line"]

    for line in lines():
        print(line)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("locusloom").getOrCreate()
    began = time.time()
    if a.command == "query":
        query(spark, a)
        return
    if a.command == "compress":
        store = compress(spark, a)
        if a.verbose:
            for name, size in store.sizes().items():
                print(f"{name}\t{size}")
            print(f"coverage share\t{store.coverage_share():.4f}")
    else:
        Store(spark, a.compressed).decompress_sam(a.expanded, a.force_xs)
    if a.verbose:
        print(f"{a.command} took {time.time() - began:.3f} s")


if __name__ == "__main__":
    main(sys.argv[1:])
