"""From documents to packed training sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last returns pieces. Decisions are
by row: a row is named by its doc_id (null is a name like others) and a hash of its text, so rows that share a doc_id but not their
text are kept or dropped each for itself. Null and empty texts pass all stages but where the classifier scores empty text below its
threshold. Ids are integers; other columns than those of documents are left out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusloom.llm import class_lm, decontam, packing, quality, secret_scan
from locusloom.llm.common import dropped, read_table, row_bytes, small_enough, staged
from locusloom.llm.ngram_join import similar_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _marked(rows: DataFrame) -> DataFrame:
    """A written list of rows (doc_id, h) as (_id, _h), marked for broadcast if its measured bytes are few enough."""
    held = staged(rows.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "rows")
    return F.broadcast(held) if small_enough(held, row_bytes(held)) else held


def _named(docs: DataFrame, marked: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are (left_semi) or aren't (left_anti) in the list."""
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("h"))
    return rows.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), how).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 go. The classifier learns from the labels of four fifths of the documents."""
    learned = class_lm.fold_of(F.col("doc_id")) != 0
    scores = quality.quality_scores(docs, read_table(spark, sf_dir, "labels"), learned)
    return _named(docs, _marked(scores.where("score < 0.3")), "left_anti")


def similarity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity one stays: the one with the smallest doc_id, no id last; of several
    texts under that id the one of the smallest hash; of equal rows one. Documents without words are in no group."""
    groups = staged(similar_components(docs, k=5, percent=75).where("component is not null").groupBy("component", "doc_id", "h").agg(F.count("*").alias("n")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("first_id"), F.col("h").alias("first_h"))).alias("first")
    best = staged(groups.groupBy("component").agg(first).select("component", "first.first_id", "first.first_h"), "best")
    told = groups.join(best, "component").withColumn("best", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    rest = _named(docs, _marked(told.where("not best")), "left_anti")
    twice = told.where("best and n > 1")
    if twice.isEmpty():
        return rest
    twice = _marked(twice)
    one = _named(rest, twice, "left_semi").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).select(COLUMNS)
    return _named(rest, twice, "left_anti").union(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more repeats windows of benchmark items go."""
    found = decontam.contamination(docs, read_table(spark, sf_dir, "benchmark"), window=13)
    return _named(docs, _marked(found.where(decontam.contaminated())), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all rows stay."""
    masked = secret_scan.scanned(docs, keep=["lang", "source"])
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, with their ids."""
    return packing.pack(docs, window=4096, keep=600_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", similarity_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"stage{k}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
