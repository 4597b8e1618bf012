import pytest
from pyspark.sql import functions as F

from locusloom.operators import sinks
from locusloom.__main__ import main
from locusloom.plans.engine import Store, ingest
from locusloom.query import older
from locusloom.sources import text
from locusloom.streaming.bundles import bundle_stream

SAM = """@HD\tVN:1.0\tSO:coordinate
@SQ\tSN:chr2\tLN:5000
@SQ\tSN:chr1\tLN:9000
r1\t0\tchr1\t100\t50\t20M100N30M\t*\t0\t0\t*\t*\tNH:i:1\tXS:A:+
r2\t81\tchr1\t110\t50\t50M\t=\t300\t0\t*\t*\tNH:i:2
r2\t161\tchr1\t300\t50\t50M\t=\t110\t0\t*\t*\tNH:i:2
r3\t4\tchr1\t400\t50\t50M\t*\t0\t0\t*\t*
r4\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*
r5\t0\tchr2\t10\t50\t30M\t*\t0\t0\t*\t*
"""
GTF = """#note
chr1\tx\texon\t120\t219\t.\t+\t.\tgene_id "g"; transcript_id "t";
chr1\tx\texon\t95\t119\t.\t+\t.\tgene_id "g"; transcript_id "t";
chr1\tx\ttranscript\t95\t219\t.\t+\t.\ttranscript_id "t"; FPKM "2.5";
"""


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "a.sam").write_text(SAM)
    (folder / "a.gtf").write_text(GTF)
    records = text.sam_records(spark, str(folder / "a.sam"))
    header = text.sam_header(spark, str(folder / "a.sam"))
    assert [tuple(r) for r in header.orderBy("ord").collect()] == [("chr2", 5000, 0), ("chr1", 9000, 1)]
    assert text.unknown_chromosomes(records, header).count() == 0
    exons = text.gtf_exons(text.gtf(spark, str(folder / "a.gtf")))
    return ingest(text.reads_of(records), header, str(tmp_path_factory.mktemp("store")), annotation=exons, cutoff=1000), exons


def test_region_queries(store):
    s, _ = store
    assert sorted(map(tuple, s.bundles("chr1").collect())) == [(100, 350)]
    assert s.bundles("chr1", 400, 500).count() == 0
    full = s.coverage_vector("chr1", 90, 360).first()["cov"]
    assert full[10] == 1.0 and full[20] == 1.5 and full[35] == 0.5 and full[209] == 0.0 and full[210] == 0.5
    parts = s.coverage_vector("chr1", 90, 200).first()["cov"] + s.coverage_vector("chr1", 200, 360).first()["cov"]
    assert parts == full
    assert s.coverage("chr2").agg(F.sum((F.col("e") - F.col("s")) * F.col("v"))).first()[0] == 30
    assert s.reads("chr1", 310, 320).count() == 1 and s.reads("chr1", 150, 200).count() == 1 and s.reads("chr1", 1000, 2000).count() == 0


def test_counts(store):
    s, exons = store
    x, j = s.counts(exons)
    got = {(r["s"], r["e"]): round(r["x"], 6) for r in x.collect()}
    assert got[(95, 120)] == round(20 / 50 + 10 / 100, 6)
    assert j.count() == 0  # the annotated exons abut


def test_sam_round_trip(spark, store, tmp_path):
    s, _ = store
    sinks.write_sam(s.placed(), s.chroms(), str(tmp_path / "out"))
    back = text.sam_records(spark, str(tmp_path / "out" / "1-alignments"))
    assert sorted((r["flag"], r["rname"], r["pos"], r["cigar"], r["tlen"]) for r in back.collect()) == [
        (0, "chr1", 100, "20M100N30M", 0), (0, "chr2", 10, "30M", 0), (81, "chr1", 110, "50M", 240), (161, "chr1", 300, "50M", -240),
    ]
    assert text.sam_header(spark, str(tmp_path / "out" / "0-header")).count() == 2


def test_decompress(store):
    s, _ = store
    got = s.decompress().collect()
    single = [[(b["s"], b["e"]) for b in r["ba"]] for r in got if r["kind"] == "unpaired" and r["ca"] == "chr2"]
    assert single == [[(10, 40)]]
    assert sum(1 for r in got if r["kind"] == "paired") == 1


def test_store_without_records(spark, tmp_path):
    """Reads, counts and text from the aggregates alone; pairs between bundles and chromosomes come back, too."""
    (tmp_path / "a.sam").write_text(
        SAM + "f1\t81\tchr1\t500\t50\t40M\t=\t4000\t0\t*\t*\tNH:i:1\nf1\t161\tchr1\t4000\t50\t20M60N20M\t=\t500\t0\t*\t*\tNH:i:1\n"
        "g1\t81\tchr1\t6000\t50\t30M\tchr2\t900\t0\t*\t*\tNH:i:1\ng1\t161\tchr2\t900\t50\t30M\tchr1\t6000\t0\t*\t*\tNH:i:1\n"
    )
    (tmp_path / "a.gtf").write_text(GTF + "".join(f'chr1\tx\texon\t{s}\t{e}\t.\t+\t.\ttranscript_id "u";\n' for s, e in ((3990, 4019), (4080, 4110))))
    main(["compress", "-c", "1000", "--aggregates-only", "-v", str(tmp_path / "a.sam"), str(tmp_path / "store")], spark)
    s = Store(spark, str(tmp_path / "store"))
    assert not s.has("rows") and not s.has("fragments") and 0 < s.coverage_share() < 1 and s.sizes()["rows"] == 0
    blocks = lambda x: None if x is None else [(b["s"], b["e"]) for b in x]
    got = sorted((r["ca"], blocks(r["ba"]), r["cb"] or "", blocks(r["bb"]) or []) for r in s.decompress().collect())
    assert got[:4] == [("chr1", [(100, 120), (220, 250)], "", []), ("chr1", [(110, 160)], "chr1", [(300, 350)]), ("chr1", [(500, 540)], "chr1", [(4000, 4020), (4080, 4100)]), ("chr2", [(10, 40)], "", [])]
    assert got[4:] == [("chr2", [(900, 930)], "chr1", [(6000, 6030)])]
    assert s.rebuilt_reads("chr1", 4000, 4010).count() == 1 and s.rebuilt_reads("chr1", 505, 510).count() == 1 and s.rebuilt_reads("chr2", 905, 910).count() == 1 and s.rebuilt_reads("chr1", 2000, 3000).count() == 0
    exons, juncs = s.counts(text.gtf_exons(text.gtf(spark, str(tmp_path / "a.gtf"))))
    assert {(r["s"], r["e"]): round(r["x"], 6) for r in juncs.collect()} == {(4020, 4080): 1.0}
    assert {(r["s"], r["e"]): round(r["x"], 6) for r in exons.where("s > 3000").collect()} == {(3990, 4020): 0.5, (4080, 4111): 0.5}
    assert [(b.chrom, b.start, b.end) for b in s][:2] == [("chr1", 100, 350), ("chr1", 500, 540)]
    assert next(iter(s)).coverage().count() > 0 and next(iter(s)).alignments().count() == 2


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.gtf").write_text(GTF)
    store, run = str(tmp_path / "store"), lambda *a: (main(list(a), spark), capsys.readouterr().out.splitlines())[1]
    run("compress", "-p", "tophat", "-g", str(tmp_path / "a.gtf"), "-c", "1000", "--intermediate", str(tmp_path / "mid"), "--codec", "gzip", str(tmp_path / "a.sam"), store)
    run("compress", "-p", "hisat", "-c", "1000", str(tmp_path / "a.sam"), store)  # takes the place of the one before
    assert run("query", "-b", "--chrom", "chr1", store) == ["100\t350"]
    assert run("query", "-c", "--chrom", "chr2", "--start", "8", "--end", "12", store) == ["0.0,0.0,1.0,1.0"]
    assert [x.split("\t")[5] for x in run("query", "-r", "--chrom", "chr2", store)] == ["30M"]
    assert run("query", "--counts", "--gtf", str(tmp_path / "a.gtf"), store)[0].startswith("chr1\t95\t120\t")
    older(["--compressed", store, "--bundles", "--chrom", "chr1"], spark)
    assert capsys.readouterr().out.splitlines() == ["100\t350"]
    run("query", "-f", "--gtf", str(tmp_path / "a.gtf"), store, str(tmp_path / "n"))
    assert spark.read.csv(str(tmp_path / "n.exons.txt"), sep="\t").count() == 2
    run("query", "-b", "--chrom", "chr1", store, str(tmp_path / "bundles"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "bundles")).collect()] == ["100\t350"]
    run("decompress", "-f", store, str(tmp_path / "out"))
    back = text.sam_records(spark, str(tmp_path / "out" / "1-alignments"))
    assert sorted((r["rname"], r["pos"], r["cigar"]) for r in back.collect()) == [("chr1", 100, "20M100N30M"), ("chr1", 110, "50M"), ("chr1", 300, "50M"), ("chr2", 10, "30M")]
    assert text.sam_records(spark, str(tmp_path / "mid" / "1-alignments")).count() == 4
    with pytest.raises(SystemExit):
        main(["query", "-b", store], spark)
    (tmp_path / "b.sam").write_text(SAM.replace("r5\t0\tchr2", "r5\t0\tchr9"))
    with pytest.raises(SystemExit):
        main(["compress", str(tmp_path / "b.sam"), str(tmp_path / "other")], spark)


def test_other_text(spark, tmp_path):
    (tmp_path / "p.pro").write_text("chr1:5-90W\tg\tCDS\t1\t2\nchr1:5-90W\th\tCDS\t1\t2\nbad\n")
    assert [tuple(r) for r in text.gene_bounds(spark, str(tmp_path / "p.pro")).collect()] == [("chr1", 5, 90, "CDS")]
    (tmp_path / "m.log").write_text("PID a b c d e MEM\n1 2 3 4 5 6 700 x\n1 2 3 4 5 6 90 x\n")
    assert text.peak_memory(spark, str(tmp_path / "m.log")).first()[0] == 700


def test_bundle_stream(spark, tmp_path):
    rows = [("c", 10, 60), ("c", 110, 130), ("c", 300, 310), ("c", 5000, 5001)]
    df = spark.createDataFrame(rows, "chrom string, s bigint, e bigint").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = bundle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bundles_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = sorted(tuple(r) for r in spark.table("bundles_out").collect())
    assert got[:2] == [("c", 10, 130, 2), ("c", 300, 310, 1)]
