"""Exact similarity join of word-shingle sets: a grouped prefix join, and the components of its links.

1. Documents with equal sets become one vertex.
2. One global order of shingles: the common ones (counted over all documents, at most ``COMMON`` are listed) come last, by count;
   all others by hash. Any order gives the same links; this one keeps common passages out of the prefixes.
3. Two sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of each. Documents with the same prefix and
   size form a group; only a group's prefix goes into the join on shingles, and what has no partner there is dropped.
4. Groups that meet are expanded to their vertices. In a bucket (the vertices that share a prefix shingle) of at most ``BUCKET``
   vertices all pairs that pass the size, position and overlap bounds are candidates. In a larger bucket each vertex first meets a
   few partners, then those outside its largest component a few more; once these are verified, only pairs of vertices in
   different components remain, and all of them are verified. So no link between components is lost, and a large group of near
   copies costs no square of its size. Shingles that are known to be hot from the counts of step 2 skip the windows over a shingle's
   postings, large buckets are dealt into parts of about ``PART`` vertices, and the remaining pairs are formed by blocks: no task
   holds all of a bucket.
5. Candidates are verified on their whole sets.

Null text and text without words have the empty set and no links; their component is their own doc_id. Rows that share a doc_id are
rows of their own; a component is named by the smallest doc_id in it that is not null. Ids are integers. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, count_floor, dropped, id_and_bytes, join_side, row_bytes, small_enough, staged, worker_of
from .components import components
from .shingles import set_key, shingle_sets

#: Shingles that are listed as common, at most; the list only orders them.
COMMON = 400_000
#: Vertices of a bucket up to which all its pairs are formed at once.
BUCKET = 40
#: A listed shingle of so many different sets is hot.
HOT = 2000
#: Vertices in a part of a large bucket, about; and in a block of the pairs that remain.
PART, BLOCK = 256, 2048
SETS = "rid bigint, doc_id bigint, h bigint, n bigint, s1 bigint, s2 bigint, gkey bigint, prefix array<bigint>, hot int"


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def common_batches(batches: Iterator[pa.RecordBatch], k: int, least: int = 2, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Shingles that occur in ``least`` or more different sets of the few thousand documents at hand, with their counts."""
    worker_of("shingles")
    held, seen, size = [], set(), 0

    def counted() -> pa.RecordBatch:
        values = np.concatenate(held)
        held.clear()
        values.sort()
        again = np.flatnonzero(values[1:] == values[:-1])  # a run of n equal values has n - 1 of these, side by side
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(again)), bool), again[1:] != again[:-1] + 1)))
        counts = np.diff(np.append(first, len(again))) + 1
        many = counts >= least
        return pa.RecordBatch.from_arrays([pa.array(signed(values[again[first[many]]])), pa.array(counts[many].astype(np.int64))], ["token", "n"])

    for whole in batches:
        for _, texts in by_bytes(whole):
            for x in shingle_sets(texts, k):
                if len(x) and (key := xxhash.xxh64_intdigest(x.tobytes())) not in seen:
                    seen.add(key)
                    held.append(x)
                    size += len(x)
            if size >= most:
                yield counted()
                seen, size = set(), 0
    if held:
        yield counted()


def prefix_of(x: np.ndarray, common: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, as many as two similar sets can't all miss. ``common``: sorted; ``place``: order by count."""
    n = len(x)
    take = n - -(-percent * n // 100) + 1
    if not len(common):
        return x[:take]
    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
    listed = common[at] == x
    rare = x[~listed]
    if len(rare) >= take:
        return rare[:take]
    rest = at[listed]
    return np.concatenate((rare, common[rest[np.argsort(place[rest], kind="stable")][: take - len(rare)]]))


def set_batches(batches: Iterator[pa.RecordBatch], k: int, percent: int, common: np.ndarray, place: np.ndarray, hot: int) -> Iterator[pa.RecordBatch]:
    """A row for each document. A group's prefix goes out once from each task (anew after many groups); its last ``hot`` shingles are hot,
    which are those from place ``hot`` on in the list."""
    worker_of("shingles")
    rid, seen = TaskContext.get().partitionId() << 40, set()
    for whole in batches:
        for batch, texts in by_bytes(whole):
            rows = []
            for x in shingle_sets(texts, k):
                if not len(x):
                    rows.append((0, None, None, None, None, None))
                    continue
                prefix = prefix_of(x, common, place, percent)
                gkey = int(np.uint64(xxhash.xxh64_intdigest(prefix.tobytes(), seed=len(x))).astype(np.int64))
                rows.append((len(x), *set_key(x), gkey, *((None, None) if gkey in seen else (signed(prefix), hot_tail(prefix, common, place, hot)))))
                seen.add(gkey)
            if len(seen) > 500_000:
                seen = set()
            n, s1, s2, g, p, w = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(rid, rid + len(n)), pa.int64()), batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in (n, s1, s2, g)), pa.array(p, pa.list_(pa.int64())), pa.array(w, pa.int32())],
                ["rid", "doc_id", "h", "n", "s1", "s2", "gkey", "prefix", "hot"],
            )
            rid += len(n)


def hot_tail(prefix: np.ndarray, common: np.ndarray, place: np.ndarray, hot: int) -> int:
    """How many of a prefix's last shingles are hot; listed ones come last, by place."""
    if hot >= len(common):
        return 0
    at = np.minimum(np.searchsorted(common, prefix), len(common) - 1)
    return int(((common[at] == prefix) & (place[at] >= hot)).sum())


def whole_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(vid, s1, s2, text) -> (vid, set), where the text's set is the vertex's; once from each task."""
    worker_of("shingles")
    seen = set()
    for whole in batches:
        vid, s1, s2 = (whole.column(c).to_pylist() for c in range(3))
        at = 0
        for batch, texts in by_bytes(pa.RecordBatch.from_arrays([whole.column(0), whole.column(3)], ["vid", "text"])):
            out = []
            for i, x in enumerate(shingle_sets(texts, k), at):
                if vid[i] not in seen and len(x) and set_key(x) == (s1[i], s2[i]):
                    seen.add(vid[i])
                    out.append((vid[i], signed(x)))
            at += batch.num_rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], ["vid", "items"])


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The listed shingles, sorted; their places by count; and the place of the first hot one."""
    found = id_and_bytes(docs).mapInArrow(lambda it: common_batches(it, k), "token bigint, n bigint")
    counts = staged(found.groupBy("token").agg(F.sum("n").alias("n")).where("n >= 16"), "common")
    rows = counts.where(F.col("n") >= count_floor(counts, COMMON)).collect()
    dropped(counts)
    token = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    count = np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(token)
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, count))] = np.arange(len(token))
    return token[order], place[order], int((count < HOT).sum())


def fits(percent: int, na, nb, i, j):
    """Size and position bounds: two sets can reach the threshold if they first meet at places i and j."""
    least = F.expr(f"({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent}")
    return (F.expr(f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})")) & (F.expr(f"least({na} - {i}, {nb} - {j})") >= least)


def dealt(rows: DataFrame, seed: str) -> DataFrame:
    """Rows of large buckets (token, vid, size, ...) twice, as ``deal`` 0 and 1, each in an order of its own: ``turn``. Buckets of more than
    about ``PART`` vertices are dealt into parts, so that the parts of one deal tie those of the other together."""
    parts = F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("size") / F.lit(PART), F.lit(1))))).cast("int")
    twice = rows.withColumn("deal", F.explode(F.array(F.lit(0), F.lit(1))))
    return twice.withColumns({"part": F.pmod(F.xxhash64("vid", "deal", F.lit(seed)), parts), "turn": F.xxhash64("vid", "deal", F.lit("turn" + seed))})


class Join:
    """The steps of the join over one table of documents; each step's table is written, and deleted once no later step reads it."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        self.spent: list[DataFrame] = []
        common, place, hot = common_shingles(docs, k)
        rows = id_and_bytes(docs).withColumn("h", F.xxhash64("text"))
        self.sets = staged(rows.mapInArrow(lambda it: set_batches(it, k, percent, common, place, hot), SETS), "sets")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("_first")
        vertices = self.sets.where("n > 0").groupBy("s1", "s2", "n", "gkey").agg(F.min("rid").alias("vid"), first)
        self.vertices = staged(vertices.select("s1", "s2", "n", "gkey", "vid", "_first.doc_id", "_first.h"), "vertices")
        self.postings = staged(self._postings(), "postings")
        self.sizes = staged(self.postings.where("many").groupBy("token").agg(F.count("*").alias("size")), "sizes")

    def _postings(self) -> DataFrame:
        """(token, vid, n, pos, many): vertices in buckets of two or more; many: the bucket is large. At pos -1 the token is a group's,
        and stands for the whole prefix that its vertices share."""
        tokens = self.sets.where("prefix is not null").select(F.posexplode("prefix").alias("pos", "token"), "gkey", (F.size("prefix") - F.col("hot")).alias("cold"))
        hot = tokens.where("pos >= cold").groupBy("token", "gkey").agg(F.min("pos").alias("pos")).withColumn("hot", F.lit(True))
        by = Window.partitionBy("token")
        met = tokens.where("pos < cold").withColumns({"low": F.min("gkey").over(by), "high": F.max("gkey").over(by), "last": F.lag("gkey").over(by.orderBy("gkey"))})
        met = met.where("low <> high and (last is null or last <> gkey)").select("token", "gkey", "pos", F.lit(False).alias("hot"))
        vertices = self.vertices.select("gkey", "vid", "n")
        shared = vertices.groupBy("gkey").agg(F.count("*").alias("c")).where("c > 1")
        shared = shared.select(F.xxhash64("gkey", F.lit("group")).alias("token"), "gkey", F.lit(-1).alias("pos"), (F.col("c") >= HOT).alias("hot"))
        rows = met.union(hot.select(met.columns)).union(shared).join(vertices, "gkey").select("token", "vid", "n", "pos", "hot")
        cold = rows.where("not hot").select("token", "vid", "n", "pos", (F.count("*").over(by) > BUCKET).alias("many"))
        return cold.union(rows.where("hot").select("token", "vid", "n", "pos", F.lit(True)))

    def close_pairs(self) -> DataFrame:
        """All pairs of the small buckets that may reach the threshold."""
        rows = self.postings.where("not many").select("token", "vid", "n", "pos")
        a, b = (rows.select("token", *(F.col(c).alias(f"{c}{x}") for c in ("vid", "n", "pos"))) for x in "ab")
        met = a.join(b, "token").where(F.expr("vida < vidb and 100 * least(na, nb) >= " + f"{self.percent} * greatest(na, nb)"))
        weight = F.expr(f"case when posa < 0 then na - ({self.percent} * na + 99) div 100 + 1 else 1 end")
        counts = met.groupBy("vida", "vidb", "na", "nb").agg(F.sum(weight).alias("shared"), F.max(fits(self.percent, "na", "nb", "posa", "posb")).alias("fits"))
        large = self.postings.where("many").groupBy("vid").agg(F.sum(F.when(F.col("pos") < 0, F.expr(f"n - ({self.percent} * n + 99) div 100 + 1")).otherwise(1)).alias("l"))
        counts = counts.join(large.select(F.col("vid").alias("vida"), F.col("l").alias("la")), "vida", "left").join(large.select(F.col("vid").alias("vidb"), F.col("l").alias("lb")), "vidb", "left")
        p = self.percent
        rest = F.expr(f"({p} * greatest(na, nb) + 99) div 100 - 1")
        least = F.expr(f"({p} * (na + nb) + {99 + p}) div {100 + p}")
        more = F.coalesce(F.least("la", "lb"), F.lit(0))
        return counts.where((F.col("fits") | (more > 0)) & (F.col("shared") + more + rest >= least)).select(F.col("vida").alias("a"), F.col("vidb").alias("b"))

    def first_pairs(self) -> DataFrame:
        """A few partners for each vertex of a large bucket, in its largest bucket and in the one it comes to first: in two deals, the two
        before it in its part, and the first of all."""
        rows = join_side(self.postings.where("many").drop("many"), self.sizes, ["token"])
        own = F.struct("token", "n", "pos", "size")
        picked = rows.groupBy("vid").agg(F.max_by(own, F.struct("size", "token")).alias("x"), F.min_by(own, F.struct("pos", "token")).alias("y"))
        rows = dealt(picked.select("vid", F.inline(F.array_distinct(F.array("x", "y")))), "first")
        order = Window.partitionBy("token", "deal", "part").orderBy("turn", "vid")
        other = F.struct("vid", "n", "pos")
        partners = F.array_distinct(F.array_compact(F.array(*(F.lag(other, i).over(order) for i in (1, 2)), F.first(other).over(order))))
        rows = rows.select("vid", "n", "pos", partners.alias("others"))
        met = rows.select("vid", "n", "pos", F.explode("others").alias("o")).select("vid", "n", "pos", "o.*").toDF("vida", "na", "posa", "vidb", "nb", "posb")
        met = met.where((F.col("vida") != F.col("vidb")) & fits(self.percent, "na", "nb", "posa", "posb"))
        return met.select(F.least("vida", "vidb").alias("a"), F.greatest("vida", "vidb").alias("b")).distinct()

    def rooted(self, roots: DataFrame) -> DataFrame:
        """Rows of the large buckets that hold several components, with their component, the bucket's size and its largest component."""
        rows = staged(self.postings.where("many").drop("many").join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid")), "rooted")
        held = rows.groupBy("token", "root").agg(F.count("*").alias("c"))
        tops = held.groupBy("token").agg(F.sum("c").alias("size"), F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("top")).where("roots > 1").drop("roots")
        tops = staged(tops, "tops")
        self.spent += [rows, tops]
        return join_side(rows, tops, ["token"])

    def far_pairs(self, rows: DataFrame) -> DataFrame:
        """More partners for those vertices of a large bucket that aren't in its largest component."""
        rows = dealt(rows, "far")
        order = Window.partitionBy("token", "deal", "part").orderBy("turn", "vid")
        own = F.struct("vid", "n", "root")
        near = F.array_compact(F.array(*(F.lag(own, i).over(order) for i in (-4, -3, -2, -1, 1, 2, 3, 4))))
        rows = rows.select("vid", "n", "root", (F.col("root") != F.col("top")).alias("far"), near.alias("others")).where("far")
        met = rows.select("vid", "n", "root", F.explode("others").alias("o")).select("vid", "n", "root", "o.*").toDF("vida", "na", "roota", "vidb", "nb", "rootb")
        met = met.where(f"roota <> rootb and 100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        return met.select(F.least("vida", "vidb").alias("a"), F.greatest("vida", "vidb").alias("b")).distinct()

    def rest_pairs(self, rows: DataFrame) -> DataFrame:
        """All pairs of the large buckets whose vertices are in different components, and that may reach the threshold.

        One of the two is not in the bucket's largest component. Sizes are classed so that similar ones are in the same class or the
        next, and a bucket's rows meet by blocks, so a task has a block of one class against a class.
        """
        ratio = F.lit(float(max(np.log(100 / self.percent), 0.01)) + 1e-9)
        held = rows.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")).withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
        some = held.where("root <> top").withColumn("block", F.pmod(F.xxhash64("vid", F.lit("block")), F.col("blocks")).cast("int"))
        every = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("class", F.explode(F.array(*(F.col("class") + i for i in (-1, 0, 1)))))
        a, b = (df.select("token", "class", "block", *(F.col(c).alias(f"{c}{x}") for c in ("vid", "n", "pos", "root"))) for df, x in ((some, "a"), (every, "b")))
        met = a.join(b, ["token", "class", "block"]).where(F.expr("roota <> rootb") & fits(self.percent, "na", "nb", "posa", "posb"))
        return met.select(F.least("vida", "vidb").alias("a"), F.greatest("vida", "vidb").alias("b")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets reach the threshold."""
        needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct().join(self.vertices, "vid").select("doc_id", "h", "vid", "s1", "s2"), "needed")
        self.spent.append(needed)
        side = F.broadcast(needed) if small_enough(needed, row_bytes(needed)) else needed
        k = self.k
        sets = self._texts(side).mapInArrow(lambda it: whole_batches(it, k), "vid bigint, items array<bigint>").dropDuplicates(["vid"])
        a, b = sets.select(F.col("vid").alias("a"), F.col("items").alias("x")), sets.select(F.col("vid").alias("b"), F.col("items").alias("y"))
        both = pairs.join(b, "b").join(a, "a").select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("i"))
        return both.where(100 * F.col("i") >= self.percent * (F.col("n") - F.col("i"))).select("a", "b")

    def _texts(self, side: DataFrame) -> DataFrame:
        docs = id_and_bytes(self.docs).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text")
        met: Column = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h"))
        return docs.join(side, met).select("vid", "s1", "s2", "text")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links that connect every component (not all links inside one), and (vid, root)."""
        done = staged(self.close_pairs().union(self.first_pairs()).distinct(), "pairs")
        links = staged(self.verified(done), "links")
        roots = components(links)
        if self.sizes.isEmpty():
            return links, roots
        for pairs in (self.far_pairs, self.rest_pairs):
            rest = staged(pairs(self.rooted(roots)).join(done, ["a", "b"], "left_anti"), "rest")
            if not rest.isEmpty():
                links = staged(links.union(self.verified(rest)), "links")
                dropped(roots)
                roots = components(links)
                done = done.union(rest)
        dropped(self.postings, self.sizes, *self.spent)
        return links, roots


def similar_components(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; h, a hash of its text; and component, a number for its component (null for rows
    with the empty set, which have none), which tells components apart whose rows have no doc_id."""
    join = Join(docs, k, percent)
    _, roots = join.links()
    vertices = staged(join.vertices.join(roots, "vid", "left").select("s1", "s2", "doc_id", F.coalesce("root", "vid").alias("root")), "rooted")
    names = staged(vertices.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")  # written, so that joins split skewed keys
    named = staged(vertices.join(names, "root").select("s1", "s2", "component_id", F.col("root").alias("component")), "named")
    dropped(names, vertices, roots, join.vertices)
    rows = join.sets.where("n > 0").select("doc_id", "h", F.col("n").alias("n_shingles"), "s1", "s2").join(named, ["s1", "s2"], "left")
    none = F.lit(None).cast("long").alias("component")
    empty = join.sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "h", none)
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "h", "component").union(empty)
