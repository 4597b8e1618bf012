"""Run-length vectors as array<struct<v bigint, len bigint>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<struct<v:bigint,len:bigint>>"


def encode(dense: Column) -> Column:
    """Runs of equal neighbours of an array<bigint>."""

    def step(a: Column, v: Column) -> Column:
        one = F.struct(v.cast("long").alias("v"), F.lit(1).cast("long").alias("len"))
        same = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["v"] == v)
        longer = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["v"].alias("v"), (F.try_element_at(a, F.lit(-1))["len"] + 1).alias("len"))))
        return F.when(same, longer).otherwise(F.concat(a, F.array(one)))

    return F.aggregate(dense, F.array().cast(RUNS), step)


def decode(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["v"], r["len"].cast("int"))))


def _ends(runs: Column) -> Column:
    """array<struct<v, s, e>> with places."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<v:bigint,s:bigint,e:bigint>>").alias("out"))
    return F.aggregate(runs, start, lambda a, r: F.struct((a["at"] + r["len"]).alias("at"), F.concat(a["out"], F.array(F.struct(r["v"].alias("v"), a["at"].alias("s"), (a["at"] + r["len"]).alias("e")))).alias("out")), lambda a: a["out"])


def value_at(runs: Column, place: Column) -> Column:
    """The value at a place, null outside."""
    return F.get(F.filter(_ends(runs), lambda r: (r["s"] <= place) & (place < r["e"])), F.lit(0))["v"]


def range_sum(runs: Column, low: Column, high: Column) -> Column:
    return F.aggregate(_ends(runs), F.lit(0).cast("long"), lambda a, r: a + r["v"] * F.greatest(F.lit(0), F.least(r["e"], high) - F.greatest(r["s"], low)))


def range_add(runs: Column, low: Column, high: Column, value: Column) -> Column:
    """``value`` added to the places [low, high); runs are split where needed."""
    part = lambda s, e, v: F.struct(v.alias("v"), (e - s).alias("len"))

    def split(r: Column) -> Column:
        a, b = F.least(F.greatest(low, r["s"]), r["e"]), F.least(F.greatest(high, r["s"]), r["e"])
        return F.filter(F.array(part(r["s"], a, r["v"]), part(a, b, r["v"] + value), part(b, r["e"], r["v"])), lambda x: x["len"] > 0)

    return F.flatten(F.transform(_ends(runs), split))
