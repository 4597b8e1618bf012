"""What the operators of this subpackage share: staged tables and null handling."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side tables below this many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session (tests) gets a temporary one, and
    any other is refused: tables in a machine's own folder would be missing on the others."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="locusloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}/{name}"
    with small_batches(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts make Spark's default of 10000 rows an Arrow batch of tens of MB, held by JVM and Python; while a table is written,
    a session that hasn't chosen otherwise has smaller ones. The session's setting is as it was afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    chosen = spark.conf.get(name)
    if chosen == "10000":
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if chosen == "10000":
            spark.conf.set(name, chosen)


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads; what isn't a staged table stays."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for file in table.inputFiles():
            whole = re.match(r"(.*/staged/[0-9a-f]{32})/", file)
            if whole:
                path = jvm.org.apache.hadoop.fs.Path(whole[1])
                path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
                break


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and the UTF-8 bytes of the text, for Arrow operators; other columns are left behind. doc_id is an integer column."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body's lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def small_enough(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the measured bytes of a side table allow a broadcast. Runs one aggregate over it."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
    return total <= limit


def row_bytes(df: DataFrame) -> Column:
    """The bytes a row takes in a broadcast hash table: its strings and arrays as they are, 8 for other columns, and 40 around them."""
    total = F.lit(40)
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + 8 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "struct", "map"):
            total = total + 16 + F.coalesce(2 * F.octet_length(F.to_json(f.name)), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


#: Over how many parts each key's rows of the large side go where a side table is too large to be broadcast.
SALTS = 32


def join_side(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a written side table: by broadcast if its measured bytes allow it, else by shuffle, where the rows of a key
    are dealt over ``SALTS`` parts and the side is repeated for each, so that no key is one task's. ``how``: inner, left,
    left_semi, left_anti."""
    if small_enough(side, row_bytes(side)):
        return rows.join(F.broadcast(side), on, how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")


def slices(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a (doc_id, text, ...) batch of about ``most`` bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most)) + 1
        part = batch.slice(at, min(end, batch.num_rows) - at)
        yield part
        at += part.num_rows


def by_bytes(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """``slices`` with their texts; null texts are empty."""
    for part in slices(batch):
        yield part, [t or b"" for t in part.column(1).to_pylist()]


#: In a Python worker: what its last task belonged to, and how to empty the tables that operators keep between tasks.
_OWNER = [""]
RELEASE: list[Callable[[], None]] = []


def worker_of(owner: str) -> None:
    """Called first in a task. Spark reuses workers, so a task of another operator first empties what the one before kept, and
    every task gives freed memory back to the system: Arrow takes its memory from the C library, and large arrays are mapped."""
    libc = None
    with contextlib.suppress(OSError):
        libc = ctypes.CDLL("libc.so.6")
    if not _OWNER[0]:
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(AttributeError):
            libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for f in RELEASE:
            f()
        gc.collect()
    with contextlib.suppress(AttributeError):
        libc.malloc_trim(0)


def count_floor(counts: DataFrame, most: int) -> int:
    """A number such that at most ``most`` rows have ``n`` of it or more: from the numbers of rows by size class (32 for each doubling
    of n), so that no task and not the driver sorts or holds the rows themselves."""
    classes = counts.groupBy(F.floor(F.log2("n") * 32).alias("c")).agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")).collect()
    total, floor = 0, max((r["high"] for r in classes), default=0) + 1
    for r in sorted(classes, key=lambda r: -r["c"]):
        total += r["rows"]
        if total > most:
            break
        floor = r["low"]
    return floor
