"""Benchmark decontamination over a positional inverted index, in built-in functions only.

The index holds postings (term, document, position) of the training texts for the terms that searches start from. For every window
of an item these are its rarest terms, by counts over all training texts (a window with a term that never occurs can't occur). A
posting at position p of a term at offset o of an item votes for the alignment p - o; alignments that a window's rarest terms agree
on are the intersection of their offset-adjusted lists. Only these are compared word by word, which gives exact phrase matches.

Words are runs of the given class after A-Z are lowered. Null text has no words and no hits; an item without words matches nothing;
hits of items with a null item_id count as hit words but name no item. Rows that share doc_id and text get the same result each;
rows that share a doc_id only, or have none, are told apart by a hash of their text. Ids may be of any type. Other columns are ignored,
whatever their names; without items nothing is hit; an empty table gives an empty result. No item side is broadcast unless its
measured bytes allow it; beyond that, the rows of a frequent term are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_side, let, row_bytes, small_enough, staged

#: Between words, once A-Z are lowered; and between words of the text as it is.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters besides A-Z that ``lower`` may change.
OTHER_CASE = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]]"


def lower_ascii(text: Column) -> Column:
    """A-Z lowered and nothing else. ``lower`` is much faster than ``translate`` and does the same where it meets no other capitals."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(OTHER_CASE)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def places(text: Column) -> Column:
    """Words by place; the first and last place may hold an empty string, which is no word."""
    return F.split(lower_ascii(text), BETWEEN)


class Search:
    """One search of all items in all documents. ``terms``: how many of a window's rarest terms must agree."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = 13, terms: int = 2):
        self.window = window
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
        words = items.where("text is not null").select("item_id", F.filter(places(F.col("text")), lambda w: w != "").alias("words")).where("size(words) > 0")
        words = words.withColumn("ik", F.sha2(F.array_join("words", " "), 256))
        self.names = staged(words.select("ik", "item_id").distinct(), "names")
        self.items = staged(words.groupBy("ik").agg(F.first("words").alias("words")).withColumn("least", F.least(F.size("words"), F.lit(window))), "items")
        self.starts = staged(self._starts(terms), "starts")
        self.postings = staged(self._postings(), "postings")

    def _starts(self, terms: int) -> DataFrame:
        """(ik, o, term, start, nth): each window's rarest terms, where all its terms occur."""
        offsets = self.items.select("ik", "least", F.size("words").alias("n"), F.posexplode("words").alias("o", "term"))
        vocabulary = staged(offsets.select("term").distinct(), "vocabulary")
        tokens = self.docs.select(F.explode(places(F.col("text"))).alias("term"))
        if small_enough(vocabulary, row_bytes(vocabulary)):
            counts = tokens.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("f"))
        else:  # counted first, so that a frequent term is a few rows in the join
            counts = tokens.groupBy("term").agg(F.count("*").alias("f")).join(vocabulary, "term", "left_semi")
        counted = join_side(offsets, staged(counts, "counts"), ["term"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
        first, last = F.greatest(F.lit(0), F.col("o") - F.col("least") + 1), F.least("o", F.col("n") - F.col("least"))
        windows = counted.withColumn("start", F.explode(F.sequence(first, last)))
        by = Window.partitionBy("ik", "start")
        ranked = windows.withColumns({"low": F.min("f").over(by), "nth": F.row_number().over(by.orderBy("f", "o"))})
        return ranked.where((F.col("low") > 0) & (F.col("nth") <= terms)).select("ik", "o", "term", "start", "nth")

    def _postings(self) -> DataFrame:
        """The index: (term, doc_id, h, pos) of the terms that windows start from."""
        terms = staged(self.starts.select("term").distinct(), "terms")
        return join_side(self.docs.select("doc_id", "h", F.posexplode(places(F.col("text"))).alias("pos", "term")), terms, ["term"]).select("term", "doc_id", "h", "pos")

    def alignments(self) -> DataFrame:
        """(doc_id, h, ik, at): places of an item's first word (before the text's start, too) that a window's rarest terms agree on."""
        anchors = staged(self.starts.select("term", "ik", "o").distinct(), "anchors")
        votes = join_side(self.postings, anchors, ["term"]).groupBy("doc_id", "h", "ik", (F.col("pos") - F.col("o")).alias("at")).agg(F.collect_set("o").alias("seen"))
        needed = self.starts.groupBy("ik", "start").agg(F.collect_set("o").alias("os")).groupBy("ik").agg(F.collect_set("os").alias("needs"))
        agreed = F.exists("needs", lambda os: F.size(F.array_except(os, F.col("seen"))) == 0)
        return join_side(votes, staged(needed, "needed"), ["ik"]).where(agreed).select("doc_id", "h", "ik", "at")

    def phrases(self) -> DataFrame:
        """(doc_id, h, ik, low, high): runs of places, both ends included, where a document repeats a whole window of an item or more."""
        found = staged(self.alignments().groupBy("doc_id", "h").agg(F.collect_set(F.struct("ik", "at")).alias("found")), "alignments")
        side = found.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
        side = F.broadcast(side) if small_enough(side, row_bytes(side)) else side
        met = self.docs.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
        met = met.select("doc_id", "h", places(F.col("text")).alias("doc"), F.explode("found").alias("x")).select("doc_id", "h", "doc", F.col("x.ik").alias("ik"), F.col("x.at").alias("at"))
        met = join_side(met, self.items, ["ik"])

        def runs(same: Column) -> Column:
            hit = lambda k: F.coalesce(F.get(same, k), F.lit(False))
            lows = F.filter(F.sequence(F.lit(0), F.size(same) - 1), lambda k: hit(k) & ~hit(k - 1))
            highs = F.filter(F.sequence(F.lit(0), F.size(same) - 1), lambda k: hit(k) & ~hit(k + 1))
            return F.arrays_zip(lows.alias("low"), highs.alias("high"))

        same = let(F.col("doc"), lambda doc: F.transform("words", lambda w, k: F.coalesce(F.get(doc, F.col("at") + k) == w, F.lit(False))))
        spans = met.select("doc_id", "h", "ik", "at", "least", let(same, runs).alias("runs"))
        spans = spans.select("doc_id", "h", "ik", "at", "least", F.inline("runs").alias("low", "high")).where("high - low + 1 >= least")
        return spans.select("doc_id", "h", "ik", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")).distinct()

    def proximity(self, within: int) -> DataFrame:
        """(doc_id, h, ik, pos): places from which all of a window's rarest terms occur, in any order, within ``within`` words."""
        needs = staged(self.starts.groupBy("ik", "start").agg(F.collect_set("term").alias("terms")), "needs")
        rows = join_side(self.postings, staged(self.starts.select("term", "ik", "start").distinct(), "windows"), ["term"])
        near = Window.partitionBy("doc_id", "h", "ik", "start").orderBy("pos").rangeBetween(0, within - 1)
        seen = rows.withColumn("seen", F.size(F.collect_set("term").over(near)))
        return join_side(seen, needs, ["ik", "start"]).where("seen = size(terms)").select("doc_id", "h", "ik", "pos").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items (sorted ids as strings); h tells texts apart."""
    search = Search(docs, items, window)
    spans = staged(search.phrases(), "spans")
    before = F.max("high").over(Window.partitionBy("doc_id", "h").orderBy("low", "high", "ik").rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("before", before).withColumn("new", F.greatest(F.lit(0), F.col("high") - F.greatest(F.col("low") - 1, F.coalesce("before", F.col("low") - 1))))
    hit = new.groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))
    named = join_side(spans.select("doc_id", "h", "ik").distinct(), search.names, ["ik"])
    ids = named.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = hit.withColumnsRenamed({"doc_id": "_id", "h": "_h"}).join(ids, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")), "left").select("_id", "_h", "n_hit", "items")
    both = staged(both, "hits")
    rows = search.docs.select("doc_id", "h", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = rows.join(both, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"))


def contaminated() -> Column:
    """A twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
