"""Token counts by rank-synchronous array merging (see ``bpe``).

Row by row over Arrow batches: no shuffle, no state but a bounded table of chunks in each worker. Null text counts as empty
(0 bytes, 0 tokens), null ids stay null, repeated rows are counted each, other columns are ignored, an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import public_path, word_bpe
from .common import by_bytes, id_and_bytes, worker_of

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    worker_of("bpe")
    bpe = word_bpe(path)
    for whole in batches:
        for batch, texts in by_bytes(whole):
            n = bpe.lengths(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether there are more than ``limit`` tokens. ``path``: a vocabulary on every machine."""
    path = path or public_path("word_bpe_49k.json")
    return id_and_bytes(docs).mapInArrow(lambda it: count_batches(it, path, limit), SCHEMA)
