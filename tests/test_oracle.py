"""A few queries of each kind against DuckDB at the smallest scale; the driver compares all of them."""

import math
import os

import duckdb
import pytest

from locusloom.plans.oracle import oracle_sql
from locusloom.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
NAMES = ["cigar_blocks", "chrom_offsets", "frag_len_cutoff", "discordance_class", "bundle_ranges", "breakpoints_annotated", "read_paths", "bucket_coverage_rle", "bucket_left_right_lens", "buckets_in_range", "coverage_segments", "coverage_from_buckets", "hisat_records", "rebuilt_coverage", "exon_counts", "junction_counts", "sam_lines", "transcript_score_reciprocal"]


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(QUERIES) - set(oracle_sql()) == {"reconstruct_reads", "reconstruct_pairs"}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("events", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    done = con.execute(oracle_sql()[name])
    at = [c[0] for c in done.description]
    assert sorted(at) == order
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in order) for r in done.fetchall()), key=str)
