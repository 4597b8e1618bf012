"""Concatenate and cut: all documents form one stream of token ids, which is cut into fixed windows.

Pass 1 tokenizes each partition and writes, beside a document's ids, how many ids of its partition come before it; the written
table fixes the order. The totals of the partitions (a row for each) give every partition's offset by a prefix sum, in a table that
is joined to the stream (broadcast if its measured bytes allow it). Pass 2 knows each document's place in the stream from these two
sums alone, so it cuts row by row; a document that crosses a window's boundary gives a record for each side.

Null text counts as empty: its only id is the end id. Ids are integers; null ids stay null, repeated rows are packed each, other
columns are ignored, an empty table gives no pieces. Only the stream's last sequence has padding; ``padded_to`` says up to where.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import public_path, word_bpe
from .common import by_bytes, id_and_bytes, join_side, staged, worker_of

STREAM = "doc_id bigint, part int, before bigint, n bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_to bigint"


def tokenize_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, keep: int) -> Iterator[pa.RecordBatch]:
    worker_of("bpe")
    bpe, part, before = word_bpe(path, keep), TaskContext.get().partitionId(), 0
    end = np.array([end_id], bpe.dtype).tobytes()
    for whole in batches:
        for batch, texts in by_bytes(whole):
            ids = [x + end for x in bpe.encode(texts)]
            n = np.array([len(x) // bpe.dtype.itemsize for x in ids], np.int64)
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "part", "before", "n", "ids"],
            )
            before = int(ends[-1])


def cut_batches(batches: Iterator[pa.RecordBatch], total: int, window: int, dtype: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    worker_of("packing")
    last = (total - 1) // window if total else 0
    rest = total - last * window
    rest = rest if rest & (rest - 1) == 0 else window  # a power of two stays as it is
    for batch in batches:
        docs, first, n, ids = (batch.column(k) for k in range(4))
        first, n = first.to_numpy(), n.to_numpy()
        pieces = np.where(n > 0, (first + n - 1) // window - first // window + 1, 0)
        row = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sequence = first[row] // window + nth
        start = np.maximum(sequence * window, first[row])
        stop = np.minimum((sequence + 1) * window, first[row] + n[row])
        crcs, out, at = [], [], -1
        for r, a, b in zip(row.tolist(), (start - first[row]).tolist(), (stop - first[row]).tolist()):
            if r != at:
                at, raw = r, np.frombuffer(ids[r].as_buffer(), dtype).astype("<u4").view(np.uint8)
            crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
            if with_ids:
                out.append(raw[4 * a : 4 * b].tobytes())
        columns = [docs.take(pa.array(row)), start - first[row], stop - start, np.array(crcs, np.int64), n[row], sequence, start - sequence * window, np.where(sequence == last, rest, window)]
        columns = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns] + ([pa.array(out, pa.binary())] if with_ids else [])
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"] + ["ids"] * with_ids)


def offsets(totals: DataFrame, block: int = 1024) -> DataFrame:
    """(part, n) -> (part, base): the sum of n over all parts before; by blocks of parts, so that no window is over all of them."""
    tiled = totals.withColumn("_block", F.expr(f"part div {block}"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = tiled.groupBy("_block").agg(F.sum("n").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in"))
    within = Window.partitionBy("_block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = tiled.withColumn("_own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return own.join(whole, "_block").select("part", (F.col("_in") + F.col("_own")).alias("base"))


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, window: int = 4096, with_ids: bool = True, keep: int = 2_400_000) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start and length in the document, sequence_id and offset in the packed stream,
    and the piece's ids (little-endian unsigned 32-bit) if ``with_ids``; their CRC-32 always. ``keep``: chunks in a worker's tables; full, they take about 0.4 GB, and smaller ones only take more time."""
    path = path or public_path("word_bpe_49k.json")
    stream = staged(id_and_bytes(docs).mapInArrow(lambda it: tokenize_batches(it, path, end_id, keep), STREAM), "stream")
    totals = staged(stream.groupBy("part").agg(F.sum("n").alias("n")), "totals")  # a row for each partition of the input
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = join_side(stream, staged(offsets(totals), "offsets"), ["part"]).select("doc_id", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    dtype = word_bpe(path).dtype.str
    return placed.mapInArrow(lambda it: cut_batches(it, total, window, dtype, with_ids), PIECES + (", ids binary" if with_ids else ""))
