"""Consistent hashing with virtual nodes and bounded loads, in DataFrame operations.

The ring has a fixed number of cells. Each shard owns ``vnodes`` cells as its virtual nodes; a key's cell is a hash of its doc_id,
and its home is the shard of the first virtual node clockwise from there. No shard takes more rows than its bound: what overflows
a full shard continues clockwise to the next shard with room. With ``slack`` 0 the bounds are n/shards rounded down or up (up for
the shards with the most home keys), so counts differ by one at most; a larger slack moves fewer keys when shards change.

Only the rows of each cell are counted and sent to the driver (at most ``cells`` numbers, whatever the input); there the cells are
walked clockwise and each is cut into ranges of ranks, one for each shard that takes part of it. Rows find their range by their
rank in their cell. Cells of more than ``LOAD`` rows (one key, or null, may have many) are dealt into parts of about that many, whose
sizes are summed before the ranks within them are added, so no task handles a whole hot cell; texts are never shuffled.

Null text has size 1; a null doc_id hashes as a value of its own; repeated rows and equal ids are placed each; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_side, staged

CELLS = 1 << 14
#: Rows of a part of a cell, about.
LOAD = 100_000


def nodes(shards: int, vnodes: int, cells: int) -> list[int]:
    """The shard that owns each cell's next virtual node clockwise. Of several nodes in a cell, the one of the lowest hash holds."""
    at: dict[int, tuple[int, int]] = {}
    for shard in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big")
            at[h % cells] = min(at.get(h % cells, (h, shard)), (h, shard))
    owner, now = [0] * cells, at[min(at)][1]
    for cell in reversed(range(cells)):
        now = at[cell][1] if cell in at else now
        owner[cell] = now
    return owner


def bounds(home: list[int], slack: float) -> list[int]:
    total, shards = sum(home), len(home)
    if slack:
        return [int(total * (1 + slack) / shards) + 1] * shards
    fullest = sorted(range(shards), key=lambda s: (-home[s], s))[: total % shards]
    return [total // shards + (s in fullest) for s in range(shards)]


def allot(counts: dict[int, int], shards: int, vnodes: int, cells: int, slack: float = 0.0) -> list[dict]:
    """Ranges of ranks: cell, low, high (exclusive), shard, and the slot of the first. Home keys come before overflow."""
    owner = nodes(shards, vnodes, cells)
    home = [0] * shards
    for cell, n in counts.items():
        home[owner[cell]] += n
    room = bounds(home, slack)
    cuts, over = defaultdict(list), []
    for cell in sorted(counts):
        take = min(counts[cell], room[owner[cell]])
        room[owner[cell]] -= take
        cuts[cell].append((0, take, owner[cell]))
        if take < counts[cell]:
            over.append((cell, take))
    for cell, low in over:
        step = cell
        while low < counts[cell]:
            step = (step + 1) % cells
            take = min(counts[cell] - low, room[owner[step]])
            if take:
                room[owner[step]] -= take
                cuts[cell].append((low, low + take, owner[step]))
                low += take
    slots, out = [0] * shards, []
    for cell in sorted(cuts):
        for low, high, shard in cuts[cell]:
            if high > low:
                out.append({"cell": cell, "low": low, "high": high, "shard": shard, "slot0": slots[shard]})
                slots[shard] += high - low
    return out


def cell_of(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("ring")), F.lit(cells)).cast("int")


def cell_counts(keys: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in keys.groupBy("cell").agg(F.count("*").alias("n")).collect()}


def table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 64, slack: float = 0.0, cells: int = CELLS) -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, shard, and slot, which counts each shard's rows from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cell_of(F.col("doc_id"), cells).alias("cell"))
    counts = cell_counts(rows)
    ring = table(docs.sparkSession, allot(counts, shards, vnodes, cells, slack), "cell int, low bigint, high bigint, shard int, slot0 bigint")
    hot = {cell: n // LOAD + 1 for cell, n in counts.items() if n > LOAD}
    if hot:  # rows are dealt by chance, so what was drawn is written
        parts = table(docs.sparkSession, [{"cell": c, "parts": n} for c, n in hot.items()], "cell int, parts int")
        dealt = rows.join(F.broadcast(parts), "cell", "left").withColumn("part", F.coalesce(F.floor(F.rand(17) * F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        rows = staged(dealt, "dealt")
        before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        held = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
        rows = join_side(rows, staged(held.select("cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases"), ["cell", "part"])
    else:
        rows = rows.withColumns({"part": F.lit(0), "base": F.lit(0).cast("long")})
    order = Window.partitionBy("cell", "part").orderBy(F.xxhash64("doc_id", F.lit("rank")), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.col("base") + F.row_number().over(order) - 1)
    held = (ranked["cell"] == ring["cell"]) & (ranked["rank"] >= ring["low"]) & (ranked["rank"] < ring["high"])
    joined = ranked.join(F.broadcast(ring), held)
    return joined.select("doc_id", "size", "text_crc32", "shard", (ring["slot0"] + ranked["rank"] - ring["low"]).cast("long").alias("slot"))


def moved(docs: DataFrame, before: int, after: int, **how) -> DataFrame:
    """How many rows change shard when ``before`` shards become ``after``; doc_ids must be unique."""
    a, b = shard(docs, before, **how), shard(docs, after, **how)
    pairs = a.select("doc_id", F.col("shard").alias("a")).join(b.select("doc_id", F.col("shard").alias("b")), "doc_id")
    return pairs.agg(F.count("*").alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("moved"))
