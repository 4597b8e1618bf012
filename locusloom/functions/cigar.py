"""CIGAR strings and blocks as Column expressions: half-open blocks in the reference, as array<struct<s bigint, e bigint>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = "array<struct<s:bigint,e:bigint>>"
_OP = r"(\d+)([MIDNSHP=X])"


def operations(cigar: Column) -> Column:
    """array<struct<n bigint, op string>>; null for ``*``."""
    n = F.transform(F.regexp_extract_all(cigar, F.lit(_OP), 1), lambda x: x.cast("long"))
    return F.when(cigar != "*", F.arrays_zip(n.alias("n"), F.regexp_extract_all(cigar, F.lit(_OP), 2).alias("op")))


def blocks(cigar: Column, pos: Column, legacy: bool = False) -> Column:
    """Aligned blocks of a record. An N closes a block, M, = and X open or extend one, D extends an open one.

    By the format's rules I, S, H and P leave the reference where it is. ``legacy``: only M opens or extends, and I, H, P, = and X
    move the reference without covering it.
    """
    match = ["M"] if legacy else ["M", "=", "X"]
    still = ["S"] if legacy else ["I", "S", "H", "P"]
    start = F.struct(pos.cast("long").alias("at"), F.lit(None).cast("long").alias("s"), F.lit(None).cast("long").alias("e"), F.array().cast(BLOCKS).alias("done"))
    closed = lambda a: F.when(a["s"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))

    def step(a: Column, x: Column) -> Column:
        to = F.when(x["op"].isin(still), a["at"]).otherwise(a["at"] + x["n"])
        opens, gap = x["op"].isin(match), x["op"] == "N"
        extends = opens | ((x["op"] == "D") & a["s"].isNotNull())
        none = F.lit(None).cast("long")
        return F.struct(
            to.alias("at"),
            F.when(gap, none).when(opens, F.coalesce(a["s"], a["at"])).otherwise(a["s"]).alias("s"),
            F.when(gap, none).when(extends, to).otherwise(a["e"]).alias("e"),
            F.when(gap, closed(a)).otherwise(a["done"]).alias("done"),
        )

    return F.aggregate(operations(cigar), start, step, closed)


def reference_length(cigar: Column) -> Column:
    """Bases of M and D."""
    return F.aggregate(operations(cigar), F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin("M", "D"), x["n"]).otherwise(0))


def read_length(b: Column) -> Column:
    return F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])


def introns(b: Column) -> Column:
    """Gaps between consecutive blocks."""
    n = F.greatest(F.size(b) - 1, F.lit(0))
    return F.zip_with(F.slice(b, F.lit(1), n), F.slice(b, F.lit(2), n), lambda x, y: F.struct(x["e"].alias("s"), y["s"].alias("e")))


def overlaps(b: Column, s: Column, e: Column) -> Column:
    return F.exists(b, lambda x: (x["s"] < e) & (x["e"] > s))


def valid(b: Column) -> Column:
    """No block starts before the one before it ends."""
    return F.forall(introns(b), lambda x: x["e"] >= x["s"])


def joined(b: Column) -> Column:
    """Blocks with abutting ones made one."""
    starts = F.filter(b, lambda x, i: (i == 0) | (F.coalesce(F.get(b, i - 1)["e"], F.lit(-1)) != x["s"]))
    ends = F.filter(b, lambda x, i: F.coalesce(F.get(b, i + 1)["s"], F.lit(-1)) != x["e"])
    return F.zip_with(starts, ends, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))


def to_cigar(b: Column) -> Column:
    """M for blocks, N for gaps; abutting blocks become one."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("m"), F.lit(None).cast("long").alias("e"))

    def step(a: Column, x: Column) -> Column:
        abuts = F.coalesce(a["e"] == x["s"], F.lit(True))
        text = F.when(abuts, a["text"]).otherwise(F.concat(a["text"], a["m"].cast("string"), F.lit("M"), (x["s"] - a["e"]).cast("string"), F.lit("N")))
        return F.struct(text.alias("text"), (F.when(abuts, a["m"]).otherwise(F.lit(0)) + x["e"] - x["s"]).alias("m"), x["e"].alias("e"))

    return F.aggregate(b, start, step, lambda a: F.concat(a["text"], a["m"].cast("string"), F.lit("M")))


def discordance(a: Column, b: Column) -> Column:
    """3: one strictly inside the other; 1: a block of b in an intron of a; 2: a block of a in an intron of b; else 0."""
    a0, a1, b0, b1 = F.get(a, F.lit(0))["s"], F.element_at(a, -1)["e"], F.get(b, F.lit(0))["s"], F.element_at(b, -1)["e"]
    within = ((a0 < b0) & (a1 > b1)) | ((b0 < a0) & (b1 > a1))
    return (
        F.when(within, 3)
        .when(F.exists(introns(a), lambda i: overlaps(b, i["s"], i["e"])), 1)
        .when(F.exists(introns(b), lambda i: overlaps(a, i["s"], i["e"])), 2)
        .otherwise(0)
    )
