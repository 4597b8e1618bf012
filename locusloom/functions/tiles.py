"""Running totals along a coordinate, by tiles.

A window over a whole chromosome is one task. Here each tile of the coordinate is a window of its own; what comes in from the tiles
before it is a running total over one row for each tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 16


def running(df: DataFrame, keys: list[str], order: str, value: str, out: str, how: str = "sum", inclusive: bool = True, tile: int = TILE) -> DataFrame:
    """``df`` with the running ``how`` (sum or max) of ``value`` by ``keys`` along ``order``, whose values are distinct by key."""
    f = {"sum": F.sum, "max": F.max}[how]
    tiled = df.withColumn("_tile", F.expr(f"`{order}` div {tile}"))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    whole = tiled.groupBy(*keys, "_tile").agg(f(value).alias("_whole")).withColumn("_in", f("_whole").over(before)).drop("_whole")
    within = Window.partitionBy(*keys, "_tile").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = tiled.withColumn("_own", f(value).over(within))
    both = own.join(whole, [*keys, "_tile"])
    if how == "sum":
        total = F.coalesce("_in", F.lit(0)) + F.coalesce("_own", F.lit(0))
    else:
        total = F.greatest("_in", "_own")
    return both.withColumn(out, total).drop("_tile", "_own", "_in")
