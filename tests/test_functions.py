import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusloom.functions import cigar as C
from locusloom.functions import records as R
from locusloom.functions import runs as V
from locusloom.functions.tiles import running

CIGARS = [
    ("76M", [(100, 176)], [(100, 176)]),
    ("44M112N32M", [(100, 144), (256, 288)], [(100, 144), (256, 288)]),
    ("5S71M", [(100, 171)], [(100, 171)]),
    ("30M2D46M", [(100, 178)], [(100, 178)]),
    ("2D10M", [(102, 112)], [(102, 112)]),
    ("10M2I64M", [(100, 174)], [(100, 176)]),
    ("5H20M", [(100, 120)], [(105, 125)]),
    ("10M5N2I10M", [(100, 110), (115, 125)], [(100, 110), (117, 127)]),
    ("10=1X10=", [(100, 121)], []),
    ("*", None, None),
]


def rows_of(value):
    return None if value is None else [(x["s"], x["e"]) for x in value]


def test_cigar_blocks(spark):
    df = spark.createDataFrame([(c,) for c, _, _ in CIGARS], "cigar string")
    got = df.select("cigar", C.blocks(F.col("cigar"), F.lit(100)).alias("b"), C.blocks(F.col("cigar"), F.lit(100), legacy=True).alias("l")).collect()
    for r, (c, want, legacy) in zip(got, CIGARS):
        assert (r["cigar"], rows_of(r["b"])) == (c, want)
        assert (r["cigar"], rows_of(r["l"])) == (c, legacy)


def test_round_trip_and_lengths(spark):
    df = spark.createDataFrame([("44M112N32M",), ("30M2D46M",), ("7M",)], "cigar string")
    got = df.select(C.to_cigar(C.blocks(F.col("cigar"), F.lit(9))).alias("c"), C.reference_length(F.col("cigar")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("44M112N32M", 76), ("78M", 78), ("7M", 7)]


@pytest.mark.parametrize(
    ("a", "b", "code"),
    [
        ([(0, 10)], [(5, 15)], 0),
        ([(0, 30)], [(5, 15)], 3),
        ([(0, 10), (20, 30)], [(12, 35)], 1),
        ([(5, 15)], [(6, 8), (20, 30)], 2),
        ([(0, 10), (20, 30)], [(22, 40)], 0),
    ],
)
def test_discordance(spark, a, b, code):
    lit = lambda bs: F.array(*(F.struct(F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e")) for s, e in bs))
    assert spark.range(1).select(C.discordance(lit(a), lit(b))).first()[0] == code


def test_record_fields(spark):
    df = spark.createDataFrame([("NH:i:3\tXS:A:-", 4), ("", 8), ("YT:Z:UP\tXS:a:+", 0)], "tags string, flag int")
    got = df.select(R.strand(F.col("tags")), R.hits(F.col("tags")), R.has(F.col("flag"), R.UNMAPPED), R.without_tag(F.col("tags"), "YT:Z:UP")).collect()
    assert [tuple(r) for r in got] == [("-", 3, True, "NH:i:3\tXS:A:-"), (None, 1, False, ""), ("+", 1, False, "XS:a:+")]


def test_bytes_needed(spark):
    got = spark.createDataFrame([(0,), (255,), (256,), (2**24,)], "v bigint").select(R.bytes_needed(F.col("v"))).collect()
    assert [r[0] for r in got] == [1, 1, 2, 4]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(0, 12), st.integers(0, 12), st.integers(-2, 2))
def test_runs(spark, dense, a, b, add):
    low, high = min(a, b), max(a, b)
    v = F.array(*(F.lit(x).cast("long") for x in dense))
    runs = V.encode(v)
    one = lambda x: F.lit(x).cast("long")
    r = spark.range(1).select(V.decode(runs).alias("d"), V.range_sum(runs, one(low), one(high)).alias("s"), V.value_at(runs, one(low)).alias("v"), V.decode(V.range_add(runs, one(low), one(high), one(add))).alias("a")).first()
    assert list(r["d"]) == dense
    assert r["s"] == sum(dense[low:high])
    assert r["v"] == (dense[low] if low < len(dense) else None)
    assert list(r["a"]) == [x + add * (low <= i < high) for i, x in enumerate(dense)]


def test_running_over_tiles(spark):
    df = spark.createDataFrame([("c", i * 7, i % 5) for i in range(60)], "k string, at bigint, v bigint")
    got = {r["at"]: (r["t"], r["m"]) for r in running(running(df, ["k"], "at", "v", "t", tile=30), ["k"], "at", "v", "m", how="max", inclusive=False, tile=30).collect()}
    total, most = 0, None
    for i in range(60):
        total += i % 5
        assert got[i * 7] == (total, most)
        most = max(i % 5, most or 0)
