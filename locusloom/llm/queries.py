"""The queries of this subpackage over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, decontam, packing, pii, quality, rules, secret_scan, sharding
from .common import read_table
from .ngram_join import similar_components
from .token_counts import token_counts


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = class_lm.fold_of(F.col("doc_id")) != 0
    scored = quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), learned)
    return scored.select("doc_id", (~learned).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=13)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, decontam.contaminated().alias("contaminated"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.stored_ledger(read_table(spark, sf_dir, "documents"))
    judged = rules.apply_policy(rules.apply_policy(book, "base-1", "base_kept"), "strict-1")
    return judged.select("doc_id", *rules.MEASURES[:5], (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("kept")).alias("kept"), "failures")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy fails, fails alone, and what would be kept without it: from the ledger's bits only."""
    return rules.ablations(rules.stored_ledger(read_table(spark, sf_dir, "documents")), "strict-1")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is for show; a caller's is a secret of its own."""
    done = pii.pseudonymized(read_table(spark, sf_dir, "documents"), key=b"locusloom-demonstration-key")
    return done.select("doc_id", "text", F.size("finds").cast("long").alias("n_finds"), F.concat_ws(",", F.array_distinct("finds.kind")).alias("kinds"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = class_lm.fold_of(F.col("doc_id")) == 1
    scored = class_lm.class_scores(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secret_scan.scanned(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_candidates", F.size("finds").cast("long").alias("n_secrets"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read_table(spark, sf_dir, "documents"), k=5, percent=75).select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), limit=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"quality_rule_ablations": quality_rule_ablations}


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, ws, least(13, len(ws)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark) WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)
), dw AS (
  SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM b))
), hits AS (
  SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, win)
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

LEDGER_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), windows AS (
  SELECT rid, i, ws[i:i + 7] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(t, '\P{Lu}', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim
  FROM w LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, CAST(n_words < 20 AS BIGINT) + CAST(100 * n_repeat_words > 30 * n_words AS BIGINT) * 2 + CAST(10 * n_symbols > 3 * n_words AS BIGINT) * 4
    + CAST(2 * n_upper > word_chars AS BIGINT) * 8 + CAST(10 * n_exclaim > 3 * n_words AS BIGINT) * 16
    + CAST(word_chars > 15 * n_words OR word_chars < 2 * n_words AS BIGINT) * 32 + CAST(n_lines >= 4 AND 10 * n_dup_lines > 4 * n_lines AS BIGINT) * 64 AS failures FROM m
)
"""
OP4_SQL = LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
ABLATIONS_SQL = LEDGER_SQL + """
SELECT rule, count(*) FILTER (WHERE failures & bit <> 0) AS fails, count(*) FILTER (WHERE failures = bit) AS alone, count(*) FILTER (WHERE failures & (127 - bit) = 0) AS kept_without
FROM f, (SELECT unnest(['too_short', 'repeated_windows', 'symbols', 'shouting', 'exclamations', 'word_length', 'duplicate_lines']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64]) AS bit)
GROUP BY rule
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS r FROM w
  UNION
  SELECT links.b AS a, reach.r FROM reach JOIN links ON links.a = reach.a WHERE reach.r < links.b
), low AS (
  SELECT a, min(r) AS r FROM reach GROUP BY a
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, low.r AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN low ON low.a = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op4_quality_rules": OP4_SQL, "quality_rule_ablations": ABLATIONS_SQL, "op9_ngram_jaccard_join": OP9_SQL}
