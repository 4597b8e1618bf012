"""Alignment record fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FLAG bits of the format (fixed values).
UNMAPPED, MATE_UNMAPPED, FIRST, SECOND = 4, 8, 64, 128


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def strand(tags: Column) -> Column:
    """``+``, ``-`` or null, from XS:A."""
    return F.nullif(F.regexp_extract(tags, r"(?:^|\t)XS:[Aa]:([+-])", 1), F.lit(""))


def hits(tags: Column) -> Column:
    """NH:i, 1 where absent."""
    return F.coalesce(F.nullif(F.regexp_extract(tags, r"(?:^|\t)NH:i:(\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def mate_chrom(rnext: Column, rname: Column) -> Column:
    return F.when(rnext == "=", rname).when(rnext != "*", rnext)


def without_tag(tags: Column, tag: str) -> Column:
    return F.array_join(F.array_remove(F.split(tags, "\t"), tag), "\t")


def bytes_needed(value: Column) -> Column:
    """Bytes of an unsigned number, one at least."""
    return F.greatest(F.ceil(F.length(F.regexp_replace(F.bin(value), "^0+", "")) / F.lit(8)), F.lit(1)).cast("int")
