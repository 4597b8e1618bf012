"""Reads rebuilt from a bucket's aggregates: its runs of coverage and its histograms of lengths.

The coverage is read as a flow: where it rises, reads start; where it falls, reads end. Every unit of it is sent from a start to an
end, so the rebuilt reads always add up to the coverage they come from. Among the ends that a start can reach, those at a distance
that the histogram still has come first; what fits no length is a chain of abutting reads, which is cut at the end so that the number
of reads comes out right. Pairs are looked up by where a mate has to end for a fragment length that the histogram still has.

All of this works on distinct (start, end) spans with their numbers, never on single bases or reads, so a deep bucket costs what its
distinct places cost. It is sequential within a bucket and runs as a Python kernel over one row for each bucket, without a shuffle
after the aggregation; its result is a function of the aggregates alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from .buckets import ID

Span = tuple[int, int]


def flow(runs: list[tuple[int, int, int]], hist: Counter) -> tuple[Counter, Counter]:
    """Runs (s, e, depth) -> reads of known lengths, and chains: spans with their numbers. ``hist`` loses what it gave.

    Places where the depth changes are taken from the left. A unit that starts at one can end at any place ahead where the depth falls
    and up to which some unit is still unsent everywhere; ``left`` holds the unsent depth after each place.
    """
    change: Counter = Counter()
    for s, e, v in runs:
        change[s] += v
        change[e] -= v
    places = sorted(p for p, w in change.items() if w)
    left, depth = [], 0
    for p in places:
        depth += change[p]
        left.append(depth)
    falls = {p: -change[p] for p in places if change[p] < 0}
    reads: Counter = Counter()
    chains: Counter = Counter()
    for i, s in enumerate(places):
        units = max(change[s], 0)
        while units:
            pick, first, room = None, None, units
            for j in range(i + 1, len(places)):
                room = min(room, left[j - 1])
                if not room:
                    break
                e = places[j]
                if falls.get(e):
                    first = first or (j, min(room, falls[e]))
                    if hist[e - s] > 0:
                        pick = (j, min(room, falls[e], hist[e - s]))
                        break
            j, n = pick or first
            e = places[j]
            if pick:
                reads[s, e] += n
                hist[e - s] -= n
            else:
                chains[s, e] += n
            units -= n
            falls[e] -= n
            for k in range(i, j):
                left[k] -= n
    return reads, chains


def cut(chains: Counter, hist: Counter) -> Counter:
    """Reads from chains: about as many as ``hist`` still has, chains of more bases first served, each cut into even parts."""
    reads: Counter = Counter()
    bases, wanted = sum((e - s) * n for (s, e), n in chains.items()), sum(hist.values())
    mean = sum(k * n for k, n in hist.items()) / wanted if wanted else 0
    parts = {c: max(1, round((c[1] - c[0]) / mean)) if mean else 1 for c in chains}
    short = wanted - sum(parts[c] * n for c, n in chains.items()) if bases else 0
    for c in sorted(chains, key=lambda c: (c[0] - c[1], c)):  # the longest first
        s, e = c
        more = max(0, min(short, chains[c] * (e - s - parts[c])))
        each, some = divmod(more, chains[c])
        for extra, n in ((each, chains[c] - some), (each + 1, some)):
            k = parts[c] + extra
            for i in range(k if n else 0):
                reads[s + (e - s) * i // k, s + (e - s) * (i + 1) // k] += n
        short -= more
    return reads


def paired_up(reads: Counter, quota: Counter, inner: list[int]) -> tuple[Counter, Counter]:
    """Unpaired spans and pairs of spans, with their numbers. ``inner``: bounds between subexons.

    A read that starts before the first bound looks first, for the longest fragment that is left, among reads that end where its mate
    has to; those that end after the last bound come first, then those that start latest. What quota remains goes to the nearest lengths.
    """
    free, quota = Counter(reads), Counter({n: f for n, f in quota.items() if f > 0})
    ending: dict[int, list[Span]] = defaultdict(list)
    for x in sorted(free):
        ending[x[1]].append(x)
    pairs: Counter = Counter()
    wide = lambda x: not inner or x[0] < inner[0]
    order = sorted(free, key=lambda x: (not wide(x), x))

    def take(one: Span, two: Span, length: int) -> None:
        n = min(free[one] // 2 if one == two else free[one], free[two], quota[length])
        if n > 0:
            pairs[min(one, two), max(one, two)] += n
            free[one] -= n
            free[two] -= n
            quota[length] -= n
            if not quota[length]:
                del quota[length]

    lengths = sorted(quota, reverse=True)
    for one in order:
        for length in lengths:
            if not free[one]:
                break
            if quota[length] and (others := ending.get(one[0] + length)):
                for two in sorted(others, key=lambda x: (bool(inner) and x[1] <= inner[-1], -x[0])):
                    if free[two] and two[0] >= one[0]:
                        take(one, two, length)
    ends = sorted({x[1] for x in free if free[x]})
    for one in sorted(free):
        while free[one] and quota and ends:
            best = None
            for length in sorted(quota):
                k = bisect_left(ends, one[0] + length)
                for e in ends[max(0, k - 1) : k + 1]:
                    two = next((x for x in reversed(ending[e]) if free[x] > (x == one)), None)
                    if two is not None and (best is None or abs(e - one[0] - length) < best[0]):
                        best = (abs(e - one[0] - length), two, length)
            if best is None:
                stale = [e for e in ends if not any(free[x] > (x == one) for x in ending[e])]
                ends = [e for e in ends if e not in set(stale)]
                if not ends or not stale:
                    break
                continue
            take(one, best[1], best[2])
            if not any(free[x] for x in ending[best[1][1]]) and best[1][1] in ends:
                ends.remove(best[1][1])
        if free[one] and one[1] not in ends:
            insort(ends, one[1])
    return +free, pairs


def divided(runs: list[tuple[int, int, int]], breaks: list[int]) -> list[list[tuple[int, int, int]]]:
    """The runs between breaks, cut there."""
    parts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for s, e, v in runs:
        at = [s, *(b for b in breaks if s < b < e), e]
        for x, y in zip(at, at[1:]):
            parts[bisect_right(breaks, x)].append((x, y, v))
    return [parts[k] for k in sorted(parts)]


def rebuild(
    runs: list[tuple[int, int, int]], unpaired: dict[int, int], paired: dict[int, int], left: dict[int, int], right: dict[int, int], inner: list[int], breaks: list[int] = ()
) -> tuple[list[Span], list[tuple[Span, Span]]]:
    """Unpaired reads and pairs of reads in bucket places, in order. No read is over one of the ``breaks``."""
    hist: Counter = Counter()
    for h in (unpaired, left, right):
        hist.update({n: f for n, f in h.items() if n > 0 and f > 0})
    if not hist or not runs:
        return [], []
    reads: Counter = Counter()
    chains: Counter = Counter()
    for part in divided(runs, list(breaks)):
        some, rest = flow(part, hist)
        reads.update(some)
        chains.update(rest)
    single, pairs = paired_up(reads + cut(chains, +hist), Counter(paired), inner)
    return sorted(single.elements()), sorted(pairs.elements())


OUT = "chrom string, bundle_id bigint, bucket bigint, kind string, n int, s bigint, e bigint, s_b bigint, e_b bigint"
COLUMNS = [x.split(" ")[0] for x in OUT.split(", ")]


def _kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out: list[tuple] = []
        for r in frame.itertuples(index=False):
            hist: dict[str, dict[int, int]] = {k: {} for k in ("unpaired", "paired", "left", "right")}
            for x in r.hists:
                hist[x["kind"]][int(x["len"])] = int(x["freq"])
            single, pairs = rebuild([(int(x["s"]), int(x["e"]), int(x["v"])) for x in r.runs], **hist, inner=[int(x) for x in r.inner], breaks=[int(x) for x in r.breaks])
            key = (r.chrom, r.bundle_id, r.bucket)
            out += [(*key, "unpaired", n, a, b, None, None) for n, (a, b) in enumerate(single)]
            out += [(*key, "paired", n, a, b, c, d) for n, ((a, b), (c, d)) in enumerate(pairs)]
            if len(out) > 100_000:
                yield pd.DataFrame(out, columns=COLUMNS).astype({"s_b": "Int64", "e_b": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=COLUMNS).astype({"s_b": "Int64", "e_b": "Int64"})


def aggregates(els: DataFrame, cover: DataFrame, lens: DataFrame) -> DataFrame:
    """One row for each bucket: inner bounds, those of them at which the path goes back or to another chromosome, coverage runs, histograms."""
    before = lambda c: F.lag(c).over(Window.partitionBy(*ID).orderBy("k"))
    turns = els.withColumn("turn", (before("chrom_e") != F.col("chrom_e")) | (before("e") > F.col("s")))
    offs = lambda when: F.sort_array(F.collect_list(F.when(when, F.col("off"))))
    shape = turns.groupBy(*ID).agg(offs(F.col("off") > 0).alias("inner"), offs(F.col("turn")).alias("breaks"))
    runs = cover.groupBy(*ID).agg(F.sort_array(F.collect_list(F.struct("s", "e", "v"))).alias("runs"))
    hists = lens.groupBy(*ID).agg(F.sort_array(F.collect_list(F.struct("kind", "len", "freq"))).alias("hists"))
    return shape.join(runs, ID).join(hists, ID)


def rebuilt(els: DataFrame, cover: DataFrame, lens: DataFrame) -> DataFrame:
    """(ID, kind, n, s, e, s_b, e_b): reads and pairs in bucket places."""
    return aggregates(els, cover, lens).mapInPandas(_kernel, OUT)


def lifted(reads: DataFrame, els: DataFrame, held: DataFrame) -> DataFrame:
    """``rebuilt`` rows as fragments: frag, strand, nh, ca, ba, cb, bb (chromosome and genomic blocks of both records; cb and bb null if
    unpaired). A record over subexons of two chromosomes, or whose blocks would go backwards, can't be placed; its mate stays alone."""
    ids = reads.join(held.select(*ID, "strand", "nh"), ID).withColumn("frag", F.xxhash64(*ID, "kind", "n"))
    side = lambda name, s, e: F.struct(F.lit(name).alias("side"), F.col(s).alias("low"), F.col(e).alias("high"))
    sides = ids.select(*ID, "frag", F.inline(F.array(side("a", "s", "e"), side("b", "s_b", "e_b")))).where("low is not null")
    spots = els.select(*ID, "k", "chrom_e", F.col("s").alias("sub_s"), F.col("e").alias("sub_e"), "off")
    met = sides.join(spots, ID).where("low < off + sub_e - sub_s and high > off")
    start, end = F.col("sub_s") + F.greatest("low", "off") - F.col("off"), F.col("sub_s") + F.least(F.col("high"), F.col("off") + F.col("sub_e") - F.col("sub_s")) - F.col("off")
    placed = met.groupBy("frag", "side").agg(
        F.min("chrom_e").alias("c"), F.max("chrom_e").alias("c2"),
        F.transform(F.sort_array(F.collect_list(F.struct("k", start.alias("s"), end.alias("e")))), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))).alias("blocks"),
    )
    ahead = F.forall(F.sequence(F.lit(1), F.size("blocks")), lambda i: (i == F.size("blocks")) | (F.get("blocks", i - 1)["e"] <= F.coalesce(F.get("blocks", i)["s"], F.lit(0))))
    both = placed.where((F.col("c") == F.col("c2")) & ahead).withColumn("blocks", C.joined(F.col("blocks"))).groupBy("frag").agg(F.sort_array(F.collect_list(F.struct("side", F.col("c").alias("c"), "blocks"))).alias("x"))
    one, two = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    told = both.select("frag", one["c"].alias("ca"), one["blocks"].alias("ba"), two["c"].alias("cb"), two["blocks"].alias("bb"))
    return ids.select(*ID, "kind", "frag", "strand", "nh").join(told, "frag")
