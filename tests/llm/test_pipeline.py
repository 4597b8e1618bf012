"""The pipeline on a small table against a brute-force version of its stages."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from locusloom.llm import class_lm, quality, secret_scan
from locusloom.llm.bpe import public_path

from .test_llm import corpus, linked

SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = corpus(80, seed=9)
    texts[11] = f'{texts[11]} token = "{SECRET}" and more'
    texts += ["!!! $$$ ### " * 20] * 3
    item = " ".join(["quo", "vadis", *(f"item{k}" for k in range(20))])
    texts += [item, item + " and a tail of other words " * 3]
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 0 if t and "$$$" in t else 1, 0) for i, t in enumerate(texts) if t]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts


def test_stages(spark, folder):
    path, texts = folder
    docs, held = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        held.append(docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    learned = class_lm.fold_of(F.col("doc_id")) != 0
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"), learned).collect()}
    kept = [i for i in range(len(texts)) if not scores[i] < 0.3]
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(held[0]) == kept
    root = linked([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if root[k][1] == k]
    assert ids(held[1]) == kept
    words = lambda t: (t or "").lower().split()
    item = words(texts[-2])
    windows = {tuple(item[k : k + 13]) for k in range(len(item) - 12)}
    dirty = [i for i in kept if any(tuple(words(texts[i])[k : k + 13]) in windows for k in range(len(words(texts[i]))))]
    assert dirty
    kept = [i for i in kept if i not in dirty]
    assert ids(held[2]) == kept
    masked = {r["doc_id"]: r for r in held[3].collect()}
    assert sorted(masked) == kept
    for i in kept:
        assert masked[i]["text"] == (texts[i].replace(SECRET, "[SECRET]") if texts[i] else texts[i]) and masked[i]["n_chars"] == (len(masked[i]["text"]) if texts[i] is not None else None)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    got: dict[int, dict] = {}
    for r in held[4].collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        got.setdefault(r["doc_id"], {})[r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    assert {i: sum((p[k] for k in sorted(p)), []) for i, p in got.items()} == {i: [*library.encode(masked[i]["text"] or "", add_special_tokens=False).ids, 2] for i in kept}


def test_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).agg(F.count_distinct("sequence_id")).first()[0] >= 1


def test_repeated_rows(spark, folder):
    path, _ = folder
    t = "one two three four five six seven eight"
    rows = [(1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, t, "en", "s", 1), (None, "some other words are here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.similarity_stage(spark, docs, path).collect()))) == ["1", "None"]


def test_rows_are_told_apart_by_their_texts(spark, folder):
    """Two unrelated texts under one id, and texts without id: each is kept or dropped for itself."""
    path, texts = folder
    item = texts[-2]
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, "one two three four five six seven"), (1, "a wholly other text of some more words"), (1, item), (None, item), (None, "a text without an id that is clean"), (None, near + " phi"), (None, near + " chi"), (7, near + " psi")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    clean = {(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination_stage(spark, docs, path).collect()}
    assert clean == {r for r in rows if r[1] != item}
    single = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.similarity_stage(spark, docs, path).collect()), key=str)
    assert single == sorted([rows[0], rows[1], rows[2], rows[4], rows[7]], key=str)
    scores = [r["score"] for r in quality.quality_scores(docs, spark.read.parquet(f"{path}/labels.parquet"), F.lit(True)).collect()]
    assert corpus_pipeline.quality_stage(spark, docs, path).count() <= len(scores)


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:4]:
        kept = stage(spark, kept, str(tmp_path))
    assert kept.count() == docs.count()


def test_forest_is_default():
    assert secret_scan.default_forest() is secret_scan.default_forest()
