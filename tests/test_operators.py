import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from locusloom.operators import bundles, counts, coverage, evaluate, intervals, pairing, preprocess, reconstruct
from locusloom.plans.context import Steps

READS = "line_no bigint, qname string, chrom string, pos bigint, cigar string, mate_chrom string, mate_pos bigint, strand string, nh int"


def reads(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], READS)


def test_bundle_radius(spark):
    df = spark.createDataFrame([("c", 1, 10), ("c", 60, 70), ("c", 121, 130), ("d", 61, 62)], "chrom string, s bigint, e bigint")
    got = sorted((r["chrom"], r["s"], r["e"]) for r in bundles.bundles(bundles.islands(df)).collect())
    assert got == [("c", 1, 70), ("c", 121, 130), ("d", 61, 62)]


def test_bundles_against_sweep(spark):
    draw = random.Random(1)
    spans = [("c", s := draw.randint(0, 900_000), s + draw.randint(1, 3000)) for _ in range(800)]
    want, at = [], None
    for _, s, e in sorted(spans):
        if at is None or s > at[1] + 50:
            at = [s, e]
            want.append(at)
        at[1] = max(at[1], e)
    df = spark.createDataFrame(spans, "chrom string, s bigint, e bigint")
    got = sorted([r["s"], r["e"]] for r in bundles.bundles(bundles.islands(df)).collect())
    assert got == want


def test_mates(spark):
    rows = [
        ("same", "c", 5, "10M", "c", 5, "+", 1), ("same", "c", 5, "9M", "c", 5, "+", 1),
        ("dup", "c", 1, "10M", "c", 50, None, 1), ("dup", "c", 1, "11M", "c", 50, None, 1), ("dup", "c", 50, "10M", "c", 1, None, 1), ("dup", "c", 50, "11M", "c", 1, None, 1),
        ("far", "d", 9, "10M", "c", 3, None, 1), ("far", "c", 3, "10M", "d", 9, "-", 1),
        ("lost", "c", 7, "10M", "c", 90, None, 1), ("alone", "c", 7, "10M", None, None, None, 1),
    ]
    df = reads(spark, rows)
    pairs = pairing.mate_pairs(df)
    assert sorted(map(tuple, pairs.collect())) == [(0, 1), (2, 4), (3, 5), (7, 6)]
    assert [r["qname"] for r in pairing.unmatched(df, pairs).collect()] == ["lost"]
    strands = {r["line_no"]: r["strand"] for r in pairing.infer_strand(df).collect()}
    assert strands[6] == "-" and strands[9] is None


def test_null_cigar_takes_mates(spark):
    df = reads(spark, [("a", "c", 5, "*", "c", 5, None, 1), ("a", "c", 5, "4M2N4M", "c", 5, None, 1), ("b", "c", 9, "*", None, None, None, 1)])
    got = {r["line_no"]: len(r["blocks"]) for r in bundles.filled(bundles.parsed(df)).collect()}
    assert got == {0: 2, 1: 2}


def test_enumeration(spark):
    left = reads(spark, [("m", "c", 1, "5M", "c", 9, None, 1), ("m", "c", 2, "5M", "c", 9, None, 1), ("o", "c", 1, "5M", "c", 9, None, 1)])
    right = reads(spark, [("m", "c", 9, "5M", "c", 1, None, 1), ("m", "c", 9, "5M", "c", 4, None, 1), ("m", "c", 9, "5M", "c", 5, None, 1), ("o", "c", 9, "5M", "c", 1, None, 1)])
    got = pairing.enumerated(left, right).collect()
    assert sorted((r["line_a"], r["line_b"], r["nh"]) for r in got if r["qname"] == "m") == [(a, b, 6) for a in (0, 1) for b in (0, 1, 2)]
    assert {(r["line_a"], r["line_b"], r["nh"]) for r in got if r["qname"] == "o"} == {(2, None, 1), (None, 3, 1)}


def test_coverage_sums(spark):
    draw = random.Random(2)
    rows = [(f"r{i}", "c", draw.randint(1, 200_000), draw.choice(["76M", "20M100N30M"]), None, None, None, draw.choice([1, 2, 4])) for i in range(300)]
    depth = Counter()
    for _, _, pos, c, *_, nh in rows:
        for s, e in [(pos, pos + 76)] if c == "76M" else [(pos, pos + 20), (pos + 120, pos + 150)]:
            for p in range(s, e):
                depth[p] += 1 / nh
    runs = coverage.segments(bundles.with_blocks(reads(spark, rows)).select("chrom", "nh", F.inline("blocks"))).collect()
    got = {p: r["v"] for r in runs for p in range(r["s"], r["e"])}
    assert got.keys() == depth.keys() and all(abs(got[p] - depth[p]) < 1e-9 for p in got)


def test_overlap_join_against_all_pairs(spark):
    draw = random.Random(3)
    make = lambda n: [("c", s := draw.randint(0, 3000), s + draw.randint(1, 1500)) for _ in range(n)]
    a, b = make(60), make(60)
    x = spark.createDataFrame(a, "chrom string, s bigint, e bigint")
    y = spark.createDataFrame(b, "chrom string, s2 bigint, e2 bigint")
    got = Counter((r["s"], r["e"], r["s2"], r["e2"]) for r in intervals.overlap_join(x, y, ["chrom"]).collect())
    assert got == Counter((s, e, s2, e2) for _, s, e in a for _, s2, e2 in b if s < e2 and e > s2)


def test_cutoff_formula(spark):
    df = reads(spark, [("a", "c", 1, "5M", "c", 101, None, 1), ("a", "c", 101, "5M", "c", 1, None, 1), ("b", "c", 5, "5M", None, None, None, 1)])
    mean = 100 / 3
    sd = (((100 - mean) ** 2 + (-100 - mean) ** 2) / 3) ** 0.5
    r = preprocess.cutoff(df, 0.5).first()
    assert abs(r["mean"] - mean) < 1e-9 and abs(r["sd"] - sd) < 1e-9 and r["cutoff"] == int(mean + 0.5 * sd)
    assert preprocess.cutoff(df.limit(0), 0.5).first()["cutoff"] == 0


def test_subexons_tile_blocks(spark):
    draw = random.Random(4)
    rows = [(f"r{i}", "c", draw.randint(1, 2000), draw.choice(["76M", "20M100N30M", "10M7N10M9N10M"]), None, None, None, 1) for i in range(80)]
    x = Steps(reads(spark, rows), 500)
    want = {r["line_no"]: sum(b["e"] - b["s"] for b in r["blocks"]) for r in x.rows.collect()}
    got = Counter()
    for r in x.incidences.collect():
        got[r["line_no"]] += r["e"] - r["s"]
    assert got == want
    assert x.fragments.count() == len(rows)


def test_junction_order(spark):
    df = spark.createDataFrame([("t", "c", 1, 50, 60), ("t", "c", 0, 10, 20), ("u", "c", 0, 10, 20)], "transcript_id string, chrom string, exon int, s bigint, e bigint")
    assert [(r["s"], r["e"]) for r in counts.junctions(df).collect()] == [(20, 50)]
    assert counts.exons(df).count() == 2


def test_scores(spark):
    kind = "transcript_id string, chrom string, exon int, s bigint, e bigint"
    a = spark.createDataFrame([("a", "c", 0, 10, 20), ("a", "c", 1, 30, 40)], kind)
    b = spark.createDataFrame([("b", "c", 0, 10, 20), ("b", "c", 1, 32, 40), ("z", "c", 0, 10, 20)], kind)
    score = lambda df: {r["b"]: round(r["score"], 6) for r in df.collect()}
    assert score(evaluate.reciprocal_scores(a, b, 10)) == {"b": 0.95, "z": 0.5}
    assert score(evaluate.product_scores(a, b, 10)) == {"b": 0.9, "z": 0.0}
    assert score(evaluate.overlap_scores(a, b)) == {"b": round(18 * 18 / (20 * 18), 6), "z": 0.5}


def runs_of(spans):
    change = Counter()
    for s, e in spans:
        change[s] += 1
        change[e] -= 1
    at, depth, out = sorted(p for p, w in change.items() if w), 0, []
    for a, b in zip(at, at[1:]):
        depth += change[a]
        if depth:
            out.append((a, b, depth))
    return out


def test_rebuild_exact():
    assert reconstruct.rebuild([(10, 86, 1)], {76: 1}, {}, {}, {}, []) == ([(10, 86)], [])
    assert reconstruct.rebuild([(5, 81, 1), (200, 276, 1)], {}, {271: 1}, {76: 1}, {76: 1}, []) == ([], [((5, 81), (200, 276))])
    assert reconstruct.rebuild([], {76: 1}, {}, {}, {}, []) == ([], []) and reconstruct.rebuild([(0, 9, 1)], {}, {}, {}, {}, []) == ([], [])
    abutting = reconstruct.rebuild([(0, 228, 1)], {76: 3}, {}, {}, {}, [])
    assert abutting == ([(0, 76), (76, 152), (152, 228)], [])
    assert reconstruct.rebuild([(0, 152, 1)], {76: 2}, {}, {}, {}, [60], [60]) == ([(0, 60), (60, 152)], [])
    assert reconstruct.rebuild([(0, 50, 2)], {50: 2}, {}, {}, {}, []) == ([(0, 50), (0, 50)], [])


@pytest.mark.parametrize("inner", [[], [120, 300]])
def test_rebuild_properties(inner):
    """The coverage comes back exactly, with as many reads as the histograms have, and no more pairs than there were."""
    counts = []
    for seed in range(60):
        draw = random.Random(seed)
        spans = [(s := draw.randint(0, 420), s + draw.randint(73, 79)) for _ in range(draw.randint(1, 40))]
        hist, paired = dict(Counter(e - s for s, e in spans)), {200: 3, 260: 2}
        single, pairs = reconstruct.rebuild(runs_of(spans), hist, paired, {}, {}, inner)
        assert (single, pairs) == reconstruct.rebuild(runs_of(spans), dict(reversed(hist.items())), paired, {}, {}, inner)
        every = [*single, *(x for p in pairs for x in p)]
        assert runs_of(every) == runs_of(spans) and len(pairs) <= 5 and all(0 <= s < e <= 500 for s, e in every)
        counts.append(abs(len(every) - len(spans)))
    assert sum(c > 0 for c in counts) <= 2 and max(counts) <= 2


def test_rebuild_finds_planted_pairs():
    """Mates that are far from others are found by their fragment's length."""
    draw = random.Random(3)
    starts = [k * 1000 for k in range(30)]
    pairs = [((s, s + 76), (s + n - 76, s + n)) for s in starts for n in [draw.choice([200, 231, 270])]]
    spans = [x for p in pairs for x in p]
    got = reconstruct.rebuild(runs_of(spans), {}, dict(Counter(b[1] - a[0] for a, b in pairs)), {76: 30}, {76: 30}, [])
    assert got == ([], sorted(pairs))


def test_rebuild_of_deep_buckets():
    """The cost follows distinct places, not reads."""
    single, pairs = reconstruct.rebuild([(0, 76, 50_000), (100, 176, 50_000)], {}, {176: 50_000}, {76: 50_000}, {76: 50_000}, [])
    assert not single and len(pairs) == 50_000 and set(pairs) == {((0, 76), (100, 176))}


def test_unsorted_over_tiles(spark):
    draw = random.Random(9)
    rows = [(k, draw.choice("cd"), draw.randint(0, 50)) for k in range(300)]
    want, last = set(), {}
    for k, c, p in rows:
        if p < last.get(c, p):
            want.add(k)
        last[c] = p
    df = spark.createDataFrame(rows, "line_no bigint, rname string, pos bigint")
    for tile in (7, 1 << 16):
        assert {r["line_no"] for r in preprocess.unsorted(df, tile).collect()} == want


def test_dense_blocks(spark):
    runs = spark.createDataFrame([(3, 8, 1.5), (8, 20, 2.0), (41, 43, 0.5)], "s bigint, e bigint, v double")
    want = [1.5 * (3 <= p < 8) + 2.0 * (8 <= p < 20) + 0.5 * (41 <= p < 43) for p in range(60)]
    for block in (1, 7, 100):
        for low, high in ((0, 60), (5, 42), (21, 30)):
            got = coverage.dense(runs, low, high, block).orderBy("s").collect()
            assert sum((r["cov"] for r in got), []) == want[low:high]
    assert coverage.dense(runs.limit(0), 0, 5).first()["cov"] == [0.0] * 5


def test_enumerated_records(spark):
    """Two left and two right records of one name stand in four pairs; names that match one to one stay."""
    kind = "line_no bigint, qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, tags string"
    row = lambda i, name, flag, pos, mate, cigar="5M", tags="NH:i:1": (i, name, flag, "c", pos, 50, cigar, "=", mate, 0, tags)
    rows = [row(0, "m", 64, 1, 9), row(1, "m", 64, 2, 9, "*"), row(2, "m", 128, 9, 1), row(3, "m", 128, 2, 1, "7M", "XS:A:+"), row(4, "o", 64, 1, 9, tags=""), row(5, "o", 128, 9, 1), row(6, "s", 0, 4, 0), row(7, "l", 64, 4, 0)]
    got = pairing.enumerated_records(spark.createDataFrame(rows, kind)).collect()
    assert len({r["line_no"] for r in got}) == len(got) == 12
    many = sorted((r["flag"], r["pos"], r["pnext"], r["cigar"], r["tags"]) for r in got if r["qname"] == "m")
    assert many == [
        (64, 1, 2, "5M", "NH:i:4"), (64, 1, 9, "5M", "NH:i:4"), (64, 2, 2, "7M", "NH:i:4"), (64, 2, 9, "*", "NH:i:4"),
        (128, 2, 1, "7M", "NH:i:4\tXS:A:+"), (128, 2, 2, "7M", "NH:i:4\tXS:A:+"), (128, 9, 1, "5M", "NH:i:4"), (128, 9, 2, "5M", "NH:i:4"),
    ]
    assert {(r["qname"], r["flag"], r["tags"]) for r in got if r["qname"] != "m"} == {("o", 64, "NH:i:1"), ("o", 128, "NH:i:1"), ("s", 0, "NH:i:1"), ("l", 64, "NH:i:1")}
    assert [r["pos"] for r in preprocess.hisat(spark.createDataFrame(rows, kind)).collect()] == sorted(r["pos"] for r in got)
